"""Palettes over the pixels made from orders: choice of entries, and palettes of segments."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fernweave.operators import palettes as P
from fernweave.plans.frames import PX, _lab, _pixels
from fernweave.plans.registry import query

#: Colours of a segment's palette.
COLOURS = 24
_COARSE = {c: f"{c} DIV 20 * 20 + 10" for c in "rgb"}


def clip_palettes(pixels: DataFrame) -> DataFrame:
    """The first 256 of a clip's colours in steps of 20: its palette."""
    coarse = pixels.selectExpr("clip", *[f"cast({e} as int) AS {c}" for c, e in _COARSE.items()]).distinct()
    entry = F.row_number().over(W.partitionBy("clip").orderBy("r", "g", "b")) - 1  # 2,197 at most
    return coarse.withColumn("entry", entry).where("entry < 256")


_SQUARED = " + ".join(f"(o{c} - e{c}) * (o{c} - e{c})" for c in "lab")
_LABS = {p: ", ".join(f"{e} AS {p}{n}" for n, e in zip("lab", _lab("r", "g", "b"), strict=True)) for p in "oe"}


@query(f"""
WITH {PX}, q AS (SELECT DISTINCT clip, {", ".join(f"CAST({e.replace(' DIV ', ' // ')} AS INT) AS {c}" for c, e in _COARSE.items())} FROM px),
p AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY r, g, b) - 1 AS entry FROM q QUALIFY entry < 256),
e AS (SELECT clip, entry, {_LABS["e"]} FROM p),
c AS (SELECT clip, r, g, b, {_LABS["o"]} FROM (SELECT DISTINCT clip, r, g, b FROM px)),
d AS (SELECT clip, r, g, b, ol, oa, ob, list_sort(list(struct_pack(d := {_SQUARED}, i := entry, l := el, a := ea, b := eb)))[1:2] AS two
 FROM c JOIN e USING (clip) GROUP BY ALL),
x AS (SELECT *, two[1] AS n, two[len(two)] AS s FROM d),
y AS (SELECT *, (s.l - n.l) * (s.l - n.l) + (s.a - n.a) * (s.a - n.a) + (s.b - n.b) * (s.b - n.b) AS w,
 (ol - n.l) * (s.l - n.l) + (oa - n.a) * (s.a - n.a) + (ob - n.b) * (s.b - n.b) AS t FROM x)
SELECT clip, r, g, b, CAST(n.i AS INT) AS nearest, CAST(s.i AS INT) AS second,
 round(CASE WHEN w <= 2.220446049250313e-16 THEN 0 ELSE least(0.5, greatest(0.0, t / w)) END, 6) AS share FROM y""")
def bucketed_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest palette entries of every colour, from buckets with a bound."""
    pixels = _pixels(spark, sf_dir)
    found = P.palette_choices(pixels.select("clip", "r", "g", "b"), clip_palettes(pixels), ["clip"])
    return found.select("clip", "r", "g", "b", "nearest", "second", F.round("share", 6).alias("share"))


@query()
def segment_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A palette for each half of a clip, around colours that both share. Iterative;
    a test holds it against a plain loop for each segment."""
    pixels = _pixels(spark, sf_dir).withColumn("segment", F.expr("cast(frame div 8 as int)"))
    found = P.segment_palettes(pixels, "clip", "segment", COLOURS, F.col("delay"))
    hexed = F.transform("colours", lambda c: F.lower(F.concat(*[F.lpad(F.hex(c[x].cast("long")), 2, "0") for x in "rgb"])))
    return found.select("clip", "segment", F.array_join(hexed, ",").alias("colours"), "sha256", "anchors")
