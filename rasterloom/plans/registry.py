"""Queries by name, each with the columns it returns and, where SQL can say it, an independent DuckDB statement.

Columns are given as "name:kind" with kind i (long), f (double, six digits), s (string) or b (boolean); both sides are cast to
them, so that engines that count in other widths still agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.palette import values_sql
from ..sources.tables import HEIGHT, WIDTH

Run = Callable[[SparkSession, str], DataFrame]
SPARK = {"i": "bigint", "s": "string", "b": "boolean"}
DUCK = {"i": "bigint", "s": "varchar", "b": "boolean"}


@dataclass
class Entry:
    run: Run
    columns: list[tuple[str, str]]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def typed(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.select(*[(F.round(F.col(n).cast("double"), 6) + 0.0 if k == "f" else F.col(n).cast(SPARK[k])).alias(n) for n, k in columns])


def typed_sql(sql: str, columns: list[tuple[str, str]]) -> str:
    cast = ", ".join(f'round(cast("{n}" as double), 6) + 0.0 as "{n}"' if k == "f" else f'cast("{n}" as {DUCK[k]}) as "{n}"' for n, k in columns)
    head, _, body = sql.rpartition("\n---\n")
    return f"{head}\nselect {cast} from ({body}) as q"


def query(name: str, columns: str, sql: str | None = None, needs: str = "") -> Callable[[Run], Run]:
    """Register a query. sql is the body of its oracle; needs names common table expressions that it reads."""
    cols = [tuple(c.split(":")) for c in columns.split()]

    def add(run: Run) -> Run:
        made = None
        if sql is not None:
            made = typed_sql(with_ctes(needs, sql), cols)
        ENTRIES[name] = Entry(lambda spark, sf_dir: typed(run(spark, sf_dir), cols), cols, made)
        return run

    return add


def with_ctes(needs: str, sql: str) -> str:
    wanted: list[str] = []

    def want(name: str) -> None:
        for below in CTES[name][0].split():
            want(below)
        if name not in wanted:
            wanted.append(name)

    for name in needs.split():
        want(name)
    parts = ",\n".join(CTES[n][1] for n in wanted)
    extra, _, body = sql.rpartition("\n===\n")  # further expressions of the query's own stand before a line of ===
    parts = ",\n".join(p for p in (parts, extra) if p)
    return (f"with recursive {parts}" if parts else "") + "\n---\n" + body


def nearest_sql(name: str) -> str:
    return f"(select frame, idx, x, y, min(((px.r - p.r) * (px.r - p.r) + (px.g - p.g) * (px.g - p.g) + (px.b - p.b) * (px.b - p.b)) * 128 + p.color) % 128 as color from px cross join pal p where p.palette = '{name}' group by frame, idx, x, y)"


def oklab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    def light(c: str) -> str:
        return f"(case when {c} / 255.0::double > 0.04045 then pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) else {c} / 255.0::double / 12.92 end)"

    cones = [" + ".join(f"{k}::double * {light(c)}" for k, c in zip(row, (r, g, b), strict=True)) for row in C.TO_CONES]
    roots = [f"(sign({c}) * pow(abs({c}), 1.0::double / 3.0::double))" for c in (f"({c})" for c in cones)]
    return tuple("(" + " + ".join(f"({k}::double) * {v}" for k, v in zip(row, roots, strict=True)) + ")" for row in C.TO_LAB)


# Common table expressions of the oracles: what each needs, and its text
CTES: dict[str, tuple[str, str]] = {
    "px": (
        "",
        f"""px as (
  select cast(event_id // 64 as int) as frame, cast(event_id % 64 as int) as idx, cast(event_id % {WIDTH} as int) as x, cast((event_id % 64) // {WIDTH} as int) as y,
    cast(case when value > 200 then (user_id * 37) % 256 else (event_id % 8) * 32 end as int) as r,
    cast(case when value > 200 then (user_id * 91) % 256 else ((event_id % 64) // 8) * 32 end as int) as g,
    cast(case when value > 200 then (user_id * 53) % 256 else (((event_id // 64) // 24) * 96) % 256 end as int) as b
  from events where event_id // 64 < (select count(*) // 64 from events))""",
    ),
    "pal": ("", f"pal(palette, color, name, block, r, g, b) as (values {values_sql()})"),
    "ix": ("px pal", "ix as " + nearest_sql("full")),
    "frames": ("px", "frames as (select distinct frame from px)"),
    "pairs": (
        "ix",
        """pairs as (
  select a.frame as f, b.frame as g, avg(case when a.color <> b.color then 1.0 else 0.0 end) as share
  from ix a join ix b on a.idx = b.idx and b.frame < a.frame and a.frame // 30 = b.frame // 30 group by a.frame, b.frame)""",
    ),
    "kinds": (
        "pairs frames",
        """kinds(frame, kind, last) as (
  select 0, 'K', 0
  union all
  select n.frame, n.kind, case when n.kind = 'S' then n.last else n.frame end from (
    select k.frame + 1 as frame, k.last, case when (k.frame + 1) % 30 = 0 then 'K' when p.share < 0.015 then 'S' else 'P' end as kind
    from kinds k left join pairs p on p.f = k.frame + 1 and p.g = k.last
    where k.frame + 1 <= (select max(frame) from frames)) n)""",
    ),
    "sent": ("ix kinds", "sent as (select i.*, k.kind, lag(i.color) over (partition by i.idx order by i.frame) as prev from ix i join kinds k using (frame) where k.kind <> 'S')"),
    "written": ("sent", "written as (select frame, idx, x, y, color, kind from sent where kind = 'K' or color <> prev)"),
    "islands": ("written", "islands as (select *, x - row_number() over (partition by frame, y, color order by x) as island from written)"),
    "cuts": ("islands", "cuts as (select *, (row_number() over (partition by frame, y, color, island order by x) - 1) // 64 as piece from islands)"),
    "runs": ("cuts", "runs as (select frame, y, color, min(x) as x0, min(idx) as start, count(*) as len from cuts group by frame, y, color, island, piece)"),
    "packed": ("runs", "packed as (select *, (cast(start as bigint) << 13) | (cast(len - 1 as bigint) << 7) | color as value from runs)"),
    "gray": ("px", "gray as (select frame, idx, x, y, (r + g + b) / 3.0::double as v from px)"),
    "edges": (
        "gray",
        """edges as (
  select frame, idx, sqrt(gx * gx + gy * gy) as edge from (
    select frame, idx,
      case when l is null then r - v when r is null then v - l else (r - l) / 2.0::double end as gx,
      case when u is null then d - v when d is null then v - u else (d - u) / 2.0::double end as gy
    from (select a.frame, a.idx, a.v, l.v as l, r.v as r, u.v as u, d.v as d from gray a
      left join gray l on l.frame = a.frame and l.y = a.y and l.x = a.x - 1 left join gray r on r.frame = a.frame and r.y = a.y and r.x = a.x + 1
      left join gray u on u.frame = a.frame and u.x = a.x and u.y = a.y - 1 left join gray d on d.frame = a.frame and d.x = a.x and d.y = a.y + 1)))""",
    ),
    "chans": ("px", "chans as (select frame, r as v from px union all select frame, g from px union all select frame, b from px)"),
    "sads": ("px", "sads as (select a.frame, avg((abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3.0::double) as sad from px a join px b on a.idx = b.idx and a.frame = b.frame + 1 group by a.frame)"),
    "hist": (
        "chans frames",
        """hist as (select f.frame, bins.bin, coalesce(c.n, 0) as n from frames f cross join range(32) as bins(bin)
  left join (select frame, v // 8 as bin, count(*) as n from chans group by all) c on c.frame = f.frame and c.bin = bins.bin)""",
    ),
    "hists": ("hist", "hists as (select a.frame, sum(abs(a.n - b.n)) / sum(a.n)::double * 255.0 as hist from hist a join hist b on a.bin = b.bin and a.frame = b.frame + 1 group by a.frame)"),
    "edged": ("edges", "edged as (select a.frame, avg(abs(a.edge - b.edge)) as edge from edges a join edges b on a.idx = b.idx and a.frame = b.frame + 1 group by a.frame)"),
    "scores": ("sads hists edged", "scores as (select frame, sad, hist, edge, 0.5 * sad + 0.3 * hist + 0.2 * edge as score from sads join hists using (frame) join edged using (frame))"),
    "walk": (
        "scores frames",
        """walk(frame, cut) as (
  select 0, 0
  union all
  select w.frame + 1, case when (s.score > 30 and w.frame + 1 - w.cut >= 20) or w.frame + 1 - w.cut >= 300 then w.frame + 1 else w.cut end
  from walk w join scores s on s.frame = w.frame + 1)""",
    ),
    "gops": (
        "walk",
        """gops as (select row_number() over (order by cut) - 1 as gop_id, cut as start_frame, coalesce(lead(cut) over (order by cut), (select max(frame) + 1 from walk)) as end_frame
  from (select distinct cut from walk))""",
    ),
    "gop_of": ("gops frames", "gop_of as (select frame, gop_id from frames join gops on frame >= start_frame and frame < end_frame)"),
    "packets": (
        "packed kinds",
        f"""bodies as (select frame, count(*) as n_runs, string_agg(value_hex, '' order by start) as body from (select *, {{leb:value}} as value_hex from packed) group by frame),
packets as (select k.frame, k.kind = 'K' as is_keyframe, coalesce(n_runs, 0) as n_runs,
    case when k.kind = 'S' then '' else {{leb:((cast(k.frame as bigint) << 1) | cast(k.kind = 'K' as bigint))}} || {{leb:coalesce(n_runs, 0)}} || coalesce(body, '') end as packet
  from kinds k left join bodies using (frame))""",
    ),
    "places": (
        "packets gop_of",
        """places as (select gop_id, frame, is_keyframe, packet, length(packet) // 2 as length, coalesce(sum(length(packet) // 2) over (partition by gop_id order by frame rows between unbounded preceding and 1 preceding), 0) as offset_
  from packets join gop_of using (frame))""",
    ),
    "decoded": ("ix pal", "decoded as (select i.frame, i.idx, p.r, p.g, p.b from ix i join pal p on p.palette = 'full' and p.color = i.color)"),
    "mates": ("px decoded", "mates as (select frame, idx, a.r as r1, a.g as g1, a.b as b1, d.r as r2, d.g as g2, d.b as b2 from px a join decoded d using (frame, idx))"),
    "both_chans": ("mates", "both_chans as (select frame, r1::double as a, r2::double as b from mates union all select frame, g1, g2 from mates union all select frame, b1, b2 from mates)"),
    "grays": ("mates", "grays as (select frame, (r1 + g1 + b1) / 3.0::double as a, (r2 + g2 + b2) / 3.0::double as b from mates)"),
    "ssims": (
        "grays",
        """ssims as (select frame, ((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)) as ssim
  from (select frame, avg(a) as ma, avg(b) as mb, var_pop(a) as va, var_pop(b) as vb, covar_samp(a, b) as cov from grays group by frame))""",
    ),
    "box": (
        "gray",
        """box as (select a.frame, a.idx, a.x, a.y, sum(b.v) as total, sum(b.v * b.v) as squares from gray a join gray b on b.frame = a.frame and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 group by all)""",
    ),
    "vars": ("box", "vars as (select frame, idx, greatest(squares / 9.0 - (total / 9.0) * (total / 9.0), 0.0) as variance from box)"),
    "luma": ("px", "luma as (select frame, idx, x, y, (0.299::double * r + 0.587::double * g + 0.114::double * b) / 255.0 as v from px)"),
    "sobel": (
        "luma",
        """sobel as (select frame, idx, 1.0 - least(1.0, greatest(0.0, sqrt(gx * gx + gy * gy) / 2.0)) as mask from (
    select a.frame, a.idx, sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y))) as gx, sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x))) as gy
    from luma a join luma b on b.frame = a.frame and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 group by a.frame, a.idx))""",
    ),
    "moved": (
        "px",
        """diffs as (select a.frame, a.idx, a.x, a.y, (abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3.0::double as v from px a join px b on a.idx = b.idx and a.frame = b.frame + 1),
moved as (select a.frame, a.idx, sum(b.v) / 9.0 as pooled from diffs a join diffs b on b.frame = a.frame and abs(b.x - a.x) <= 1 and abs(b.y - a.y) <= 1 group by a.frame, a.idx)""",
    ),
    "tiles": (
        "ix",
        """tiles as (select frame, x // 4 as tx, y // 4 as ty, string_agg(cast(color as varchar), ',' order by (y % 4) * 4 + x % 4) as px, md5(string_agg(cast(color as varchar), ',' order by (y % 4) * 4 + x % 4)) as digest from ix group by frame, x // 4, y // 4)""",
    ),
    "dict": (
        "tiles",
        """dict as (select digest, row_number() over (order by frame, ty, tx) - 1 as tile_id, frame as first_frame, px
  from (select *, row_number() over (partition by digest order by frame, ty, tx) as rn from tiles) where rn = 1)""",
    ),
    "shifts": (
        "px",
        """sums as (
  select a.frame, a.x // 4 as bx, a.y // 4 as by_, dx.d as dx, dy.d as dy, sum(abs((a.r + a.g + a.b) - (b.r + b.g + b.b))) as sad, count(*) as n
  from px a cross join range(-2, 3) as dx(d) cross join range(-2, 3) as dy(d) join px b on b.frame = a.frame - 1 and b.x = a.x - dx.d and b.y = a.y - dy.d group by all),
shifts as (select frame, bx, by_, dx, dy, sad from (select *, row_number() over (partition by frame, bx, by_ order by sad, abs(dx) + abs(dy), dy, dx) as rn from sums where n = 16) where rn = 1)""",
    ),
}


def lab_sql(r: str, g: str, b: str) -> tuple[str, str, str]:
    """CIE L*a*b* of sRGB channels."""

    def light(c: str) -> str:
        return f"(case when {c} / 255.0::double > 0.04045 then pow(({c} / 255.0::double + 0.055) / 1.055, 2.4) else {c} / 255.0::double / 12.92 end)"

    def f(t: str) -> str:
        return f"(case when {t} > 0.008856 then pow({t}, 1.0::double / 3.0::double) else 7.787::double * {t} + 16.0::double / 116.0::double end)"

    x, y, z = (f("((" + " + ".join(f"{k}::double * {light(c)}" for k, c in zip(row, (r, g, b), strict=True)) + f") / {w}::double)") for row, w in zip(C.TO_XYZ, C.WHITE, strict=True))
    return f"(116.0::double * {y} - 16.0)", f"(500.0::double * ({x} - {y}))", f"(200.0::double * ({y} - {z}))"


_P, _Q = lab_sql("r1", "g1", "b1"), lab_sql("r2", "g2", "b2")
CTES["des"] = (
    "mates",
    f"""labs0 as materialized (select frame, {", ".join(f"{v} as {n}" for v, n in zip((*_P, *_Q), ("l1", "a1", "m1", "l2", "a2", "m2"), strict=True))} from mates),
labs1 as materialized (select *, 0.5 * (1 - sqrt(pow((sqrt(a1 * a1 + m1 * m1) + sqrt(a2 * a2 + m2 * m2)) / 2, 7) / (pow((sqrt(a1 * a1 + m1 * m1) + sqrt(a2 * a2 + m2 * m2)) / 2, 7) + pow(25.0::double, 7)))) as g from labs0),
labs2 as materialized (select *, sqrt((1 + g) * a1 * (1 + g) * a1 + m1 * m1) as c1, sqrt((1 + g) * a2 * (1 + g) * a2 + m2 * m2) as c2, degrees(atan2(m1, (1 + g) * a1)) as h1r, degrees(atan2(m2, (1 + g) * a2)) as h2r from labs1),
labs3 as materialized (select *, case when h1r < 0 then h1r + 360 else h1r end as h1, case when h2r < 0 then h2r + 360 else h2r end as h2 from labs2),
labs4 as materialized (select *, case when c1 * c2 = 0 then 0 when abs(h2 - h1) <= 180 then h2 - h1 when h2 - h1 > 180 then h2 - h1 - 360 else h2 - h1 + 360 end as dh,
  case when c1 * c2 = 0 then h1 + h2 when abs(h2 - h1) <= 180 then (h1 + h2) / 2 when h1 + h2 < 360 then (h1 + h2 + 360) / 2 else (h1 + h2 - 360) / 2 end as hm, (c1 + c2) / 2 as cm, (l1 + l2) / 2 as lm from labs3),
labs5 as materialized (select *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)) as t from labs4),
labs6 as materialized (select frame, (l2 - l1) / (1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) as u, (c2 - c1) / (1 + 0.045 * cm) as v, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * t) as w,
  -2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0::double, 7))) * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) as rt from labs5),
des as (select frame, avg(sqrt(u * u + v * v + w * w + rt * v * w)) as delta_e from labs6 group by frame)""",
)
CTES["texts"] = (
    "places",
    """bytes_of(kind, hexed) as (
  select gop_id, string_agg(packet, '' order by frame) from places group by gop_id
  union all select -1, string_agg({leb:gop_id} || {leb:((cast(offset_ as bigint) << 1) | cast(is_keyframe as bigint))} || {leb:length}, '' order by frame) from places),
bits_of as (select kind, array_to_string(list_transform(range(length(hexed) // 2), lambda i: lpad(bin(('0x' || substr(hexed, i * 2 + 1, 2))::bigint), 8, '0')), '') as b from bytes_of),
padded as (select kind, (15 - length(b) % 15) % 15 as pad, b || repeat('0', (15 - length(b) % 15) % 15) as b from bits_of),
texts as (select kind, chr(cast(4096 + pad as int)) || array_to_string(list_transform(range(length(b) // 15), lambda i: chr(cast(4096 + list_sum(list_transform(range(15), lambda k: (substr(b, i * 15 + k + 1, 1) = '1')::bigint << (14 - k))) as int))), '') as t from padded)""",
)


def leb_sql(value: str) -> str:
    """Unsigned LEB128 of a value as upper-case hex digits."""

    def byte(i: int, more: bool) -> str:
        part = f"(({value}) >> {7 * i}) & 127"
        return f"format('{{:02X}}', cast(({part}) {'| 128' if more else ''} as bigint))"

    def whole(n: int) -> str:
        return " || ".join(byte(i, i < n - 1) for i in range(n))

    cases = " ".join(f"when ({value}) < {1 << 7 * n} then {whole(n)}" for n in range(1, 5))
    return f"(case {cases} else {whole(5)} end)"


def _filled(text: str) -> str:
    import re

    return re.sub(r"\{leb:(.*?)\}", lambda m: leb_sql(m[1]), text)


CTES |= {k: (a, _filled(b)) for k, (a, b) in CTES.items() if "{leb:" in b}
SIZE = WIDTH * HEIGHT
