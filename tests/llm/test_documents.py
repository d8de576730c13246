"""Operators on documents against brute force, with odd rows of every kind."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import fingerprints, licenses, line_dedup, mixing, near_dedup, toxicity

from .helpers import BASE, by_id, components, no_docs, odd_docs, odd_rows

WHITE = " \t\n\x0b\x0c\r"


def ascii_lower(s: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


# --- line dedup


def brute_lines(rows, least=20, docs=3):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = ascii_lower(line.strip(WHITE))
            if len(key) >= least:
                holders.setdefault(key, set()).add(i)
    top = {k: max(h, key=lambda i: (i is not None, i)) for k, h in holders.items() if len(h) >= docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if top.get(ascii_lower(x.strip(WHITE)), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_of_odd_rows(spark):
    plan = line_dedup.line_dedup(odd_docs(spark), carry=("text",))
    got = [tuple(r) for r in line_dedup.kept_text(plan).select("doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sorted(got, key=repr) == brute_lines([r[:2] for r in odd_rows()])
    assert line_dedup.line_dedup(no_docs(spark), carry=("text",)).count() == 0


def test_hot_line_over_many_partitions(spark):
    rows = [(i, f"this very line is in all documents\nown line of document {i} {'dup' if i % 5 else 'pair'} {i // 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = line_dedup.line_dedup(docs, carry=("text",))
        got = [tuple(r) for r in line_dedup.kept_text(plan).select("doc_id", "n_lines", "n_dropped", "kept").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(got, key=repr) == brute_lines(rows)


def test_an_id_of_many_rows(spark):
    """A document of 3,000 rows in the middle of a key's documents: more places than wait in memory."""
    line, other = "a line that many rows of one document hold", "and this is one of two documents alone"
    rows = [(9, f"{line}\n{other}"), (3, f"x\n{line}\n{line}"), *((5, f"row {i}\n{line}\n{other}") for i in range(3000)), *((5, f"row 1\n{line}\n{other}") for _ in range(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = line_dedup.line_dedup(docs, kept_col="kept").select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)


def test_rows_without_ids_are_spread(spark):
    """100,000 rows without an id, all with one line: what goes from each is its own, and tasks are even."""
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("this line is in every single row\nrow "), "id").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1, "this line is in every single row"), (2, "this line is in every single row")], "doc_id long, text string"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.line_dedup(docs, kept_col="kept").withColumn("task", F.spark_partition_id())
        tasks = out.groupBy("task").agg(F.count("*").alias("n"), F.sum("n_dropped").alias("gone")).collect()
        mixed = mixing.mix(docs.withColumns({"lang": F.lit("en"), "source": F.lit("src0")}), mixing.PRODUCTION, mixing.by_number(F.col("source")), share=0.5, max_epochs=1)
        taken = mixed.agg(F.sum("n_tokens").alias("n")).first()["n"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["n"] for r in tasks) == 100_002 and sum(r["gone"] for r in tasks) == 100_001
    assert len(tasks) == 16 and max(r["n"] for r in tasks) < 2 * 100_002 / 16
    total = 9 * 100_000 + 2 * 7
    assert total / 2 <= taken < total / 2 + 9


def test_bitmaps():
    keep = np.random.default_rng(1).random(1000) < 0.5
    assert (line_dedup.unpack_bitmap(line_dedup.pack_bitmap(keep)) == keep).all()
    assert line_dedup.apply_bitmap(None, line_dedup.pack_bitmap([True])) == ""
    assert line_dedup.apply_bitmap("a\nb", line_dedup.pack_bitmap([False, False])) == ""


# --- near dedup


def shingles(text, k):
    w = ascii_lower(text or "").encode("utf-8", "surrogatepass").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_near(rows, k, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(text, k))

    def linked(a, b):
        return any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])

    return components(sorted(sets), linked)


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.85), (5, 0.8)])
def test_near_of_odd_rows(spark, k, threshold):
    want = brute_near([r[:2] for r in odd_rows()], k, round(threshold * 100))
    got = near_dedup.near_dedup(odd_docs(spark), k=k, threshold=threshold).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got)
    assert sizes == sorted((r[0] or -1, len(shingles(r[1], k))) for r in odd_rows())
    assert {(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(9 if k == 0 else want[11], False), (None, True)}
    assert near_dedup.near_dedup(no_docs(spark), k=k, threshold=threshold).count() == 0


def test_near_group_that_shares_too_little(spark):
    """Hundreds of copies with more and more changes: some linked, many not; the steps after the first leader decide."""
    rng = np.random.default_rng(5)
    rows = []
    for n in range(400):
        words = BASE.split()
        for at in rng.choice(len(words), rng.integers(0, 9), replace=False):
            words[at] = f"z{rng.integers(0, 60)}"
        rows.append((n, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = brute_near(rows, 3, 85)
    for options in ({}, {"peels": 0, "leader_rounds": 0}, {"peels": 1, "leader_rounds": 3}):
        got = near_dedup.near_dedup(docs, k=3, threshold=0.85, **options).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def slow_superminhash(elements, slots):
    """Element by element, with a whole permutation each."""
    mask, sig = 2**64 - 1, [2**64 - 1] * slots

    def mixed(x):
        x = (x ^ x >> 30) * near_dedup.MIX_A & mask
        x = (x ^ x >> 27) * near_dedup.MIX_B & mask
        return x ^ x >> 31

    for e in elements:
        perm = list(range(slots))
        for level in range(slots):
            r = mixed((int(e) + near_dedup.GOLDEN * (level + 1)) & mask)
            to = level + ((r & 0xFFFFFFFF) * (slots - level) >> 32)
            perm[level], perm[to] = perm[to], perm[level]
            sig[perm[level]] = min(sig[perm[level]], level << 32 | r >> 32)
    return sig


def test_signatures_and_their_estimate():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 5, 40, 400, 3000)]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sig = near_dedup.superminhash(np.concatenate(sets), owner, len(sets), 64)
    for s, row in zip(sets[:5], sig, strict=False):
        assert row.tolist() == slow_superminhash(s, 64)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 300, dtype=np.uint64)
        b = np.concatenate((a[:240], rng.integers(0, 2**63, 60, dtype=np.uint64)))
        x = near_dedup.superminhash(np.concatenate((a, b)), np.repeat([0, 1], 300), 2, 256)
        errors.append((x[0] == x[1]).mean() - 240 / 360)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.2 * (2 / 9 / 256) ** 0.5


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(1, 300) if i % 50] + [(1000, 5), (1000, 260), (7, 7)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    want = components(sorted({x for link in links for x in link}), lambda a, b: (a, b) in links or (b, a) in links)
    assert got == {n: r for n, r in want.items() if n != r}


# --- fingerprints


def canonical(s):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s or "").casefold())).strip()


def test_fingerprints_of_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    got = by_id(fingerprints.edited_fingerprints(odd_docs(spark)).collect())
    assert sum(map(len, got.values())) == len(rows)
    ids = sorted({i for i, _ in rows if i is not None})
    text_of = {i: t or "" for i, t in rows if i is not None}
    prints = {}
    for i, text in rows:
        s = text or ""
        after = text_of[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else ""
        q = len(s) // 4
        edited = s[: len(s) - q] + after[:q]
        row = next(r for r in got[i] if r["n_chars"] == len(s) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest())
        assert row["near_edited"] == float(canonical(s) == canonical(edited))
        assert row["near_next"] == float(i is not None and canonical(s) == canonical(after))
        assert prints.setdefault(canonical(s), row["fingerprint"]) == row["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    assert fingerprints.edited_fingerprints(no_docs(spark)).count() == 0


def test_colliding_fingerprints_come_apart(spark, monkeypatch):
    """With a hash of the length alone, bytes decide."""
    monkeypatch.setattr(fingerprints, "wide_hash", lambda canon: F.length(canon).cast("string"))
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA "), (4, "bb"), (5, "ccc")], "doc_id long, text string")
    groups = {r["doc_id"]: r["group_id"] for r in fingerprints.exact_groups(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.edited_fingerprints(docs).collect()}
    assert prints[1] == prints[3] != prints[2] == prints[4]


# --- licences


def test_licences(spark):
    mit = dict(licenses.FULL_TEXTS)["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.replace("Software", "SOFTWARE").replace('"', "“")), (2, "text\nreleased under the MIT  Licence!\nmore\nLicensed under CC BY-NC 4.0."),
        (3, mit + " and more"), (4, None), (5, ""), (6, "Licensed under the Apache License, version 2.0"), (7, "permission"), (7, "Released under the MIT License."), (None, "!!!"),
    ]
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, digest string, notices string")
    got = by_id(licenses.scan(docs).collect())
    assert [(r["license_id"], r["notices"], r["n_notices"]) for r in got[1]] == [("MIT", "", 0)]
    assert [(r["license_id"], r["notices"], r["n_notices"]) for r in got[2]] == [(None, "CC-BY-NC-4.0,MIT", 2)]
    assert [r["license_id"] for r in got[6]] == ["Apache-2.0"] and [r["license_id"] for r in got[3]] == [None]
    assert sorted((r["license_id"] or "", r["notices"]) for r in got[7]) == [("", "MIT"), ("MIT", "MIT")]
    assert all(r["license_id"] is None and r["n_notices"] == 0 for i in (4, 5, None) for r in got[i])
    assert licenses.scan(no_docs(spark)).count() == 0
    own = licenses.scan(docs, known=(("none", "permission"), ("marks", "more text")))
    assert sum(r["license_id"] == "none" for r in own.collect()) == 1


def test_whole_texts_and_usual_notices_of_common_licences(spark):
    texts = {f: (licenses.FOLDER / f"{f}.txt").read_text() for f in ("Apache-2.0", "BSD-3-Clause", "BSL-1.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "Unlicense", "Zlib")}
    assert all(licenses.anchored(body) for _, body in licenses.KNOWN)
    two = re.sub(r"3\. Neither.*?permission\.", "", texts["BSD-3-Clause"], flags=re.S)
    rows = [*texts.items(), ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + two.replace("1. ", "* ").replace("2. ", "* "))]
    rows += [("BSD-3-Clause", "Copyright (c) 2020 X. All rights reserved.\n" + texts["BSD-3-Clause"].replace("HOLDER OR", "OWNER OR")), ("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + dict(licenses.FULL_TEXTS)["MIT"])]
    rows += [("Zlib", "zlib License\n\n(C) 2020 X\n\n" + " ".join(texts["Zlib"].split())), ("BSL-1.0", texts["BSL-1.0"].partition("2003")[2]), ("Unlicense", texts["Unlicense"].replace("http:", "https:"))]
    rows += [("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("GPL-3.0", "Released under the GNU GPL, v3"), ("MIT", "// SPDX-License-Identifier: MIT"), ("0BSD", "Available under 0BSD"), (None, two + "\nand more")]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs).collect()}
    assert [got[n] for n in range(len(rows))] == [i for i, _ in rows]


def test_texts_inside_documents(spark):
    """Known texts among a document's paragraphs, marked as comments or not; parts of them and parts of two rows are none."""
    mit = dict(licenses.FULL_TEXTS)["MIT"]
    boost = (licenses.FOLDER / "BSL-1.0.txt").read_text().partition("2003")[2]
    commented = "\n".join(f" * {x}".rstrip() for x in f"Copyright (c) 2020 X\n\n{mit}".split("\n"))
    first, _, rest = mit.partition("\n\n")
    rows = [
        (1, f"# A project\n\nSome words.\n\nCopyright (c) 2020 X\n\n{mit}\n\nMore words."), (2, f"/*\n{commented}\n */\n\nint main() {{}}\n"), (3, f"intro\n\n{boost}\n\n{mit}\n\n{mit}"),
        (4, f"{mit} and more"), (5, f"intro\n\n{rest}\n\n{first}"), (None, f"a\n\n{first}"), (None, f"{rest}\n\nb"), (6, "Use it:\n\nLicensed under the Apache\nLicense, Version 2.0.\n\nend"),
    ]
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, texts string, digest string")
    got = by_id(licenses.scan(docs).collect())
    assert [got[n][0]["texts"] for n in range(1, 7)] == ["MIT", "MIT", "BSL-1.0,MIT", "", "", "Apache-2.0"] and [r["texts"] for r in got[None]] == ["", ""]
    assert all(r["license_id"] is None and r["n_notices"] == 0 for own in got.values() for r in own)


def test_the_filter_is_sound(spark):
    """Anchors that normalising removes from a known text don't count."""
    known = (("X", "Copyright (c) 2020 Creative People\nfoo bar"), ("Y", "permission of the owner"))
    docs = spark.createDataFrame([(1, "foo bar"), (2, "Foo, bar!"), (3, "permission of the owner"), (4, "a\n\nfoo\nbar")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["texts"]) for r in licenses.scan(docs, known=known).collect()}
    assert got == {1: ("X", "X"), 2: ("X", "X"), 3: ("Y", "Y"), 4: (None, "X")}
    assert licenses.all_anchored(spark, licenses.KNOWN) and not licenses.all_anchored(spark, known)


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).toPandas()
    pos, neg = scored[scored.toxic == 1].score.to_numpy(), scored[scored.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.8 and (neg >= 0.5).mean() < 0.1
    assert [r["h"] for r in spark.range(50).select(toxicity.held_out("id").alias("h")).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(300 + n, n % 2) for n in range(40)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    for own in (labels, labels.where("false")):
        model = toxicity.fit(docs, own)
        got = toxicity.score(docs, model, carry=("doc_id", "text")).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
        scores = {}
        assert all(scores.setdefault(r["text"] or "", r["score"]) == r["score"] for r in got)
    assert toxicity.score(no_docs(spark), model).count() == 0


def slow_logit(model, text: str) -> float:
    """A score's logit by plain loops over n-grams and windows."""
    top = 1 << 64

    def bucket(h: int) -> int:
        h = (h ^ h >> 29) * toxicity.EVEN % top
        return (h ^ h >> 32) * toxicity.ODD % top >> (64 - model.bits)

    def word_logit(w: str) -> float:
        marked, found = f"<{w}>", [bucket(zlib.crc32(w.encode()))]
        for n in range(model.shortest, model.longest + 1):
            for i in range(len(marked) - n + 1):
                h = ord(marked[i])
                for c in marked[i + 1 : i + n]:
                    h = (h * toxicity.ODD + ord(c)) % top
                found.append(bucket((h + n) % top))
        return sum(float(model.weights[b]) for b in found) / len(found)

    logits = [word_logit(w) for t in text.lower().split() for w in toxicity.words_of(t)]
    windows = [logits[i : i + model.window] for i in range(max(len(logits) - model.window + 1, 1))]
    return max((sum(w) / len(w) for w in windows if w), default=0.0) + model.bias


def test_scores_by_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.where(F.length("text") < 3000), model, carry=("doc_id", "text")).collect()
    assert len(scored) > 100
    for r in scored:
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(slow_logit(model, r["text"] or ""), -60, 60))), abs=1e-9)


def test_joint_training_learns_misspellings():
    """Labels are learned from n-grams: other texts, and words that no text has, are told apart."""
    rng = np.random.default_rng(3)
    clean, bad = ["sun", "river", "stone", "cloud", "meadow", "lantern"], ["grubnak", "vilezor"]
    texts = [" ".join([*rng.choice(clean, 12), *(rng.choice(bad, 1) if i % 2 else [])]) for i in range(400)]
    model = toxicity.train(texts[:200], [i % 2 for i in range(200)], bits=14)
    scores = toxicity.Scorer(model)([*texts[200:], "a grubnakk by the river", "the viilezor of the meadow", "a meadow by the river"])
    assert ((scores[:200] >= 0.5) == (np.arange(200) % 2 == 1)).mean() > 0.97
    assert min(scores[200:202]) > scores[202]


def test_training_rows_are_bounded(spark):
    """One id's many rows give one text; several labels of an id are one."""
    docs = spark.range(5000).select((F.col("id") % 3 + 1).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    texts, own = toxicity.gather_rows(docs, labels, 2, "doc_id", "text", "toxic")
    known = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    assert texts == [f"text {min((x for x in range(5000) if x % 3 + 1 == i), key=str)}" for i in known] and own == [{1: 1, 2: 0, 3: 1}[i] for i in known]


def test_grams_by_hand():
    words = ["a", "toxic", "x" * 24]
    word, bucket = toxicity.grams(words, 3, 6, 18)
    counts = np.bincount(word)
    assert counts.tolist() == [sum(max(len(w) + 2 - n + 1, 0) for n in range(3, 7)) + 1 for w in words]
    alone, single = toxicity.grams(["toxic"], 3, 6, 18)
    assert sorted(single) == sorted(bucket[word == 1])
    scorer = toxicity.Scorer(toxicity.Model(np.random.default_rng(0).normal(size=1 << 18), 0.1, 2, 3, 6), most=3)
    texts = ["some words, here!", "other-words it's", None, "", "!!! ???", "some words, here!"]
    first = scorer(texts)
    assert first[0] == first[5] and first[2] == first[3] == first[4] and (scorer(texts) == first).all()


# --- mixing


def test_budgets_go_to_siblings_first():
    w = mixing.Weights(domain={"a": 1, "b": 1}, lang={"en": 1, "fr": 1}, source={"s": 1, "t": 3})
    supply = {("a", "en", "s"): 10, ("a", "en", "t"): 100, ("a", "fr", "s"): 100, ("b", "en", "s"): 1000, ("b", "xx", "s"): 50}
    got = mixing.budgets(supply, w, 200, 1)
    assert got == {("a", "en", "s"): 10, ("a", "en", "t"): 40, ("a", "fr", "s"): 50, ("b", "en", "s"): 100, ("b", "xx", "s"): 0}
    got = mixing.budgets(supply, w, 1000, 1)
    assert got[("a", "en", "t")] == 100 and got[("b", "en", "s")] == 790
    assert sum(mixing.budgets(supply, w, 10**9, 2).values()) == 2 * 1210


def brute_mix(rows, weights, share, epochs, seed, keys):
    """rows: (row number, doc_id, leaf, tokens); keys: the order key of (epoch, row number)."""
    supply = {}
    for _, _, leaf, n in rows:
        supply[leaf] = supply.get(leaf, 0) + n
    given = mixing.budgets(supply, weights, share * sum(supply.values()), epochs)
    out = []
    for leaf, total in supply.items():
        own = [r for r in rows if r[2] == leaf]
        passes, rest = divmod(given[leaf], total) if total else (0, 0)
        out += [(r[1], r[3], e) for r in own for e in range(passes)]
        seen = 0
        for r in sorted(own, key=lambda r: (keys[passes, r[0]], r[3])):
            if seen >= rest:
                break
            out.append((r[1], r[3], passes))
            seen += r[3]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("share", "epochs"), [(0.6, 3), (0.9, 1), (3.0, 4)])
def test_mix_against_brute_force(spark, share, epochs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mixing.mix(docs, mixing.PRODUCTION, mixing.by_number(F.col("source")), share=share, max_epochs=epochs)
    leaves = mixing.leaves_of(docs, mixing.PRODUCTION, mixing.by_number(F.col("source")), "doc_id", "text", None).collect()
    keyed = spark.range(epochs + 1).select(F.col("id").alias("e")).crossJoin(docs.select("doc_id")).select("e", "doc_id", mixing.order_key(17, F.col("e"), F.col("doc_id")).alias("k"))
    keys = {(r["e"], r["doc_id"]): r["k"] for r in keyed.collect()}
    rows = [(r["doc_id"], r["doc_id"], (r["domain"], r["lang"], r["source"]), r["n_tokens"]) for r in leaves]
    want = brute_mix(rows, mixing.PRODUCTION, share, epochs, 17, keys)
    assert sorted(((r["doc_id"], r["n_tokens"], r["epoch"]) for r in got.collect()), key=repr) == want


def test_mix_of_odd_rows(spark):
    everything = mixing.Weights(domain={"web": 1, "other": 1, "news": 1, "books": 1, "forums": 1}, lang={"en": 1, "other": 1}, source={**{f"src{i}": 1 for i in range(20)}, "other": 1})
    got = mixing.mix(odd_docs(spark), everything, mixing.by_number(F.col("source")), share=1.0, max_epochs=1).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len(re.findall(r"\S+", r[1] or "", re.ASCII)) for r in odd_rows())
    assert mixing.mix(no_docs(spark), everything, mixing.by_number(F.col("source"))).count() == 0


def test_unlisted_and_null_leaves_share_the_production_budget(spark):
    rows = [(i, "two words", lang, source) for i, (lang, source) in enumerate([("en", "src0"), ("en", "blog"), ("it", "src7"), (None, "src12"), ("fr", None), ("de", "src25"), (None, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, mixing.PRODUCTION, mixing.by_number(F.col("source")), share=1.0, max_epochs=1).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    hot = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 300, "crawl").otherwise("src0").alias("source"))
    got = mixing.mix(hot, mixing.PRODUCTION, mixing.by_number(F.col("source")), share=0.6, max_epochs=1).collect()
    assert sum(r["n_tokens"] for r in got) == 480 and len({r["doc_id"] for r in got if r["source"] == "other"}) == 140
