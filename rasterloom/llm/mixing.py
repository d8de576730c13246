"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree domain - language - source. Each node splits its budget among its children by weight; a
child never gets more than its leaves can give (their tokens times max_epochs). What one child can't take goes to its
siblings by weight; only what a whole family can't take goes up to its parent's siblings. Each leaf then reads its
documents in seeded epochs: whole passes while the budget lasts, then the prefix of one more pass, whose order is a hash
of seed, epoch and id. The prefix ends with the document in which the budget ends.

The prefix is found without sorting a leaf: token sums over 4096 ranges of the hash, then over 4096 ranges within the
range where the budget ends, leave about one document in 16 million to be put in order, and of those that share hash
and tokens, as rows of one id may, only their number. What goes to the driver is a row for each leaf; leaves are named by the
weights, so their number is that of the weights, not of the rows. Rows are selected where they stand, by their leaf's
row, without a shuffle or a join by id.

Nulls, ties, empties: a null or unnamed domain, language or source is "other", which has weight 0 unless it is named; a
null or empty text has 0 tokens and goes with its place in the order. Rows that share an id and so a hash are taken in
the order of their tokens; equal rows can't be told apart. A null id is replaced by the hash of its text, so rows without ids
spread like others. An empty table gives an empty table. Extra columns aren't read; selected() keeps them, and needs
names other than those of its own, which start with mix_.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LEVELS = ("domain", "lang", "source")


@dataclass
class Weights:
    """Weights of the children of each level; they are compared within a family only."""

    domain: dict[str, float]
    lang: dict[str, float]
    source: dict[str, float]
    pairs: dict[tuple[str, ...], float] = field(default_factory=dict)  # of single nodes, by path from the root

    def of(self, path: tuple[str, ...]) -> float:
        return max(0.0, self.pairs.get(path, getattr(self, LEVELS[len(path) - 1]).get(path[-1], 0.0)))


def split(budget: float, caps: list[float], weights: list[float]) -> list[float]:
    """Shares of a budget by weight, none above its cap; what a capped child leaves goes to the others by weight."""
    out, active, left = [0.0] * len(caps), [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0], budget
    while active and left > 1e-9:
        total = sum(weights[i] for i in active)
        full = [i for i in active if caps[i] <= left * weights[i] / total]
        if not full:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        active = [i for i in active if i not in full]
    return out


def budgets(supply: dict[tuple[str, ...], int], weights: Weights, total: float, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Token budget of each leaf (domain, lang, source)."""
    caps: dict[tuple[str, ...], float] = {}
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for leaf in sorted(supply):
        if all(weights.of(leaf[: n + 1]) > 0 for n in range(len(leaf))):
            for n in range(len(leaf)):
                if leaf[: n + 1] not in caps:
                    caps[leaf[: n + 1]] = 0.0
                    children.setdefault(leaf[:n], []).append(leaf[: n + 1])
                caps[leaf[: n + 1]] += supply[leaf] * max_epochs
    given: dict[tuple[str, ...], float] = {(): total}
    queue: list[tuple[str, ...]] = [()]
    for node in queue:
        own = children.get(node, [])
        given |= dict(zip(own, split(given[node], [caps[c] for c in own], [weights.of(c) for c in own]), strict=True))
        queue += own
    return {leaf: min(round(given.get(leaf, 0.0)), supply[leaf] * max_epochs) for leaf in supply}


def named(column: Column, names: dict[str, float]) -> Column:
    return F.when(column.isin(*names), column).otherwise("other") if names else F.lit("other")


def words(text: Column) -> Column:
    """Tokens of a text: its runs of characters that aren't white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def leaf(docs: DataFrame, weights: Weights, domain: Column) -> list[Column]:
    return [named(domain, weights.domain).alias("domain"), named(F.col("lang"), weights.lang).alias("lang"), named(F.col("source"), weights.source).alias("source")]


def tokens_of(text_col: str, tokens: Column | None) -> Column:
    return words(F.col(text_col).cast("string")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))


def place_of(id_col: str, text_col: str) -> Column:
    """The number that a row's order follows from: its id, or a hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def leaves_of(docs: DataFrame, weights: Weights, domain: Column, id_col: str, text_col: str, tokens: Column | None) -> DataFrame:
    """The narrow table of all rows: doc_id, leaf, n_tokens, place."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *leaf(docs, weights, domain), tokens_of(text_col, tokens).alias("n_tokens"), place_of(id_col, text_col).alias("place"))


def order_key(seed: int, epoch: Column, place: Column) -> Column:
    """The place of a row in a pass: 48 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), epoch.cast("long"), place), 16)


def plan(rows: DataFrame, weights: Weights, share: float, max_epochs: int) -> list[tuple[str, str, str, int, int]]:
    """(domain, lang, source, whole passes, tokens of the last pass) for each leaf; the budget is `share` of all tokens."""
    got = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).collect()  # a row for each leaf
    supply = {tuple(r[x] for x in LEVELS): r["n"] for r in got}
    given = budgets(supply, weights, share * sum(supply.values()), max_epochs)
    return [(*leaf, *divmod(given[leaf], n)) if n else (*leaf, 0, 0) for leaf, n in sorted(supply.items())]


def cuts(rows: DataFrame, weights: Weights, share: float, max_epochs: int, seed: int) -> DataFrame:
    """A row for each leaf: domain, lang, source, passes, rest, cut_key, cut_tokens. rows: a written table of leaves_of."""
    spark = rows.sparkSession
    leaves = spark.createDataFrame(plan(rows, weights, share, max_epochs), "domain string, lang string, source string, passes long, rest long")
    keyed = rows.join(F.broadcast(leaves), list(LEVELS)).withColumn("key", order_key(seed, F.col("passes"), F.col("place")))
    cut = cutoffs(keyed.where("rest > 0"))
    cut = spark.createDataFrame(cut.collect(), cut.schema)  # a row for each leaf
    return leaves.join(cut, list(LEVELS), "left")


def copies(passes: Column, rest: Column, cut_key: Column, cut_tokens: Column, key: Column, tokens: Column) -> Column:
    """How many epochs take a row."""
    within = (key < cut_key) | ((key == cut_key) & (tokens <= cut_tokens))
    return passes + F.when((rest > 0) & within, 1).otherwise(0)


def mix(
    docs: DataFrame, weights: Weights, domain: Column, share: float = 0.6, max_epochs: int = 3, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
) -> DataFrame:
    """A row for each selected row and epoch: doc_id, domain, lang, source, n_tokens, epoch."""
    rows = shared.write(leaves_of(docs, weights, domain, id_col, text_col, tokens), "leaves")
    marked = rows.join(F.broadcast(cuts(rows, weights, share, max_epochs, seed)), list(LEVELS))
    n = copies(*map(F.col, ("passes", "rest", "cut_key", "cut_tokens")), order_key(seed, F.col("passes"), F.col("place")), F.col("n_tokens"))
    return marked.withColumn("n", n).where("n > 0").select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("epoch"))


def selected(
    docs: DataFrame, weights: Weights, domain: Column, share: float = 0.6, max_epochs: int = 3, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
) -> DataFrame:
    """The rows of docs that are taken, as they are, with mix_copies, by how many epochs."""
    rows = shared.write(leaves_of(docs, weights, domain, id_col, text_col, tokens), "leaves")
    told = cuts(rows, weights, share, max_epochs, seed)
    told = told.select(*[F.col(c).alias(f"mix_{c}") for c in told.columns])
    of_leaf = [(a == F.col(f"mix_{c}")) for a, c in zip(leaf(docs, weights, domain), LEVELS, strict=True)]
    marked = docs.join(F.broadcast(told), of_leaf[0] & of_leaf[1] & of_leaf[2])
    # words are counted of rows at the cut alone
    n = copies(*(F.col(f"mix_{c}") for c in ("passes", "rest", "cut_key", "cut_tokens")), order_key(seed, F.col("mix_passes"), place_of(id_col, text_col)), tokens_of(text_col, tokens))
    return marked.withColumn("mix_copies", n).where("mix_copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns], "mix_copies")


def cutoffs(keyed: DataFrame) -> DataFrame:
    """The last place of each leaf's prefix as (domain, lang, source, cut_key, cut_tokens)."""
    ranges = [F.shiftrightunsigned("key", 36), F.shiftrightunsigned("key", 24)]
    inside = keyed.withColumn("before", F.lit(0).cast("long"))
    for n, place in enumerate(ranges):
        # the range of the hash in which the budget ends, and the tokens before it
        sums = inside.groupBy(*LEVELS, "rest", "before", place.alias("range")).agg(F.sum("n_tokens").alias("n"))
        run = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("to", F.col("before") + F.sum("n").over(run))
        ends = sums.where("to >= rest").groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("to") - F.col("n")).alias("before"))).alias("s")).select(*LEVELS, "s.range", "s.before")
        ends = keyed.sparkSession.createDataFrame(ends.collect(), ends.schema)  # a row for each leaf
        inside = shared.write(keyed.withColumn("range", place).join(F.broadcast(ends), [*LEVELS, "range"]).drop("range"), f"range-{n}")
    # rows with one hash and size can't be told apart: their groups are put in order, so that one id's many rows are one row here
    groups = inside.groupBy(*LEVELS, "rest", "before", "key", "n_tokens").agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy(*LEVELS).orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ordered = groups.withColumn("to", F.col("before") + F.sum("n").over(run)).where("to >= rest")
    return ordered.groupBy(*LEVELS).agg(F.min(F.struct("key", "n_tokens")).alias("s")).select(*LEVELS, F.col("s.key").alias("cut_key"), F.col("s.n_tokens").alias("cut_tokens"))


def by_number(source: Column, names: tuple[str, ...] = ("web", "news", "books", "forums"), each: int = 5) -> Column:
    """A domain for sources that end in a number: the first `each` numbers are the first domain's, and so on."""
    number = F.regexp_extract(source, r"(\d{1,9})$", 1)
    place = F.floor(number.try_cast("int") / each)
    return F.element_at(F.array(*map(F.lit, names)), F.when(place.between(0, len(names) - 1), place.cast("int") + 1))


# Unlisted and null values weigh as much as the least named one of their level
PRODUCTION = Weights(
    domain={"web": 0.4, "news": 0.3, "books": 0.2, "forums": 0.1, "other": 0.1},
    lang={"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2, "other": 0.2},
    source={**{f"src{i}": 1.0 for i in range(20)}, "other": 1.0},
)
