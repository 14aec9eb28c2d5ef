"""Fuzzy answers over bars, and the links of pages made absolute."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links
from ..operators import fuzzy
from ..session import table
from .context_queries import _X, _context
from .define import query

_INPUTS = {
    "momentum": {"weak": ("z", 20, 60), "strong": ("s", 40, 80)},
    "relative_volume": {"thin": ("triangle", 0, 0, 1.5), "usual": ("triangle", 0.5, 1, 2), "heavy": ("trapezoid", 1, 2, 50, 100)},
}
_OUTPUT = {"out": ("z", 0.1, 0.5), "hold": ("bell", 0.5, 2, 0.2), "in": ("s", 0.5, 0.9)}
#: A row a condition, as `rules_of` reads them.
_RULES = [
    (1, "momentum", "strong", False, "in", 1.0), (1, "relative_volume", "heavy", False, "in", 1.0), (2, "momentum", "weak", True, "out", 0.9), (2, "relative_volume", "thin", True, "out", 0.9), (3, "relative_volume", "usual", False, "hold", 1.0),
]
_LINEAR = [(0.2, {"momentum": 0.008}), (0.1, {"momentum": 0.002, "relative_volume": 0.05}), (0.5, {})]

_STRENGTH = """mm AS (SELECT symbol, i, momentum, relative_volume,
   CASE WHEN momentum <= 40 THEN 0 WHEN momentum <= 60 THEN 2 * pow((momentum - 40) / 40, 2) WHEN momentum < 80 THEN 1 - 2 * pow((80 - momentum) / 40, 2) ELSE 1 END AS strong,
   1 - CASE WHEN momentum <= 20 THEN 0 WHEN momentum <= 40 THEN 2 * pow((momentum - 20) / 40, 2) WHEN momentum < 60 THEN 1 - 2 * pow((60 - momentum) / 40, 2) ELSE 1 END AS weak,
   greatest(0, 1 - relative_volume / 1.5) AS thin, CASE WHEN relative_volume <= 1 THEN greatest(0, (relative_volume - 0.5) / 0.5) ELSE greatest(0, 2 - relative_volume) END AS usual,
   CASE WHEN relative_volume < 2 THEN greatest(0, relative_volume - 1) WHEN relative_volume <= 50 THEN 1 ELSE greatest(0, (100 - relative_volume) / 50) END AS heavy
   FROM x WHERE momentum IS NOT NULL AND relative_volume IS NOT NULL),
 w AS MATERIALIZED (SELECT *, least(strong, heavy) AS w1, 0.9 * greatest(weak, thin) AS w2, usual AS w3 FROM mm)"""


def _rules(spark):
    return fuzzy.rules_of(spark.createDataFrame(_RULES, "rule int, variable string, term string, any_of boolean, conclusion string, weight double"))


def _bars(spark, sf_dir):
    return _context(spark, sf_dir).select("symbol", F.col("i").cast("int").alias("i"), "momentum", "relative_volume").where("momentum is not null and relative_volume is not null")


@query(f"""WITH {_X}, {_STRENGTH}, gr AS (SELECT k, k / 100 AS v, CASE WHEN k IN (0, 100) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS f,
   CASE WHEN k <= 10 THEN 1 WHEN k <= 30 THEN 1 - 2 * pow((k - 10) / 40, 2) WHEN k < 50 THEN 2 * pow((50 - k) / 40, 2) ELSE 0 END AS out_, 1 / (1 + pow(abs((k / 100 - 0.5) / 0.2), 4)) AS hold,
   CASE WHEN k <= 50 THEN 0 WHEN k <= 70 THEN 2 * pow((k - 50) / 40, 2) WHEN k < 90 THEN 1 - 2 * pow((90 - k) / 40, 2) ELSE 1 END AS in_ FROM range(0, 101) r(k)),
 u AS (SELECT symbol, i, f * greatest(least(in_, w1), least(out_, w2), least(hold, w3)) AS area, v FROM w, gr)
 SELECT symbol, i, round(sum(area * v) / nullif(sum(area), 0), 6) AS exposure FROM u GROUP BY symbol, i""")
def fuzzy_mamdani(spark, sf_dir):
    """How much to hold, by rules on momentum and volume: the centroid of the clipped union."""
    d = fuzzy.mamdani(_bars(spark, sf_dir), _INPUTS, _OUTPUT, 0.0, 1.0, _rules(spark), "exposure")
    return d.select("symbol", "i", F.round("exposure", 6).alias("exposure"))


@query(f"""WITH {_X}, {_STRENGTH} SELECT symbol, i, round((w1 * (0.2 + 0.008 * momentum) + w2 * (0.1 + 0.002 * momentum + 0.05 * relative_volume) + w3 * 0.5) / nullif(w1 + w2 + w3, 0), 6) AS exposure FROM w""")
def fuzzy_sugeno(spark, sf_dir):
    rules = [fuzzy.Rule(r.when, then, r.any, r.weight) for r, then in zip(_rules(spark), _LINEAR)]
    d = fuzzy.sugeno(_bars(spark, sf_dir), _INPUTS, rules, "exposure")
    return d.select("symbol", "i", F.round("exposure", 6).alias("exposure"))


#: Links as pages have them, and as folders, hosts and dots would write them.
_FORMS = ["{}", "..{}", ".{}", "a/b/../.{}", "//other.example.org{}/../x", "?q=1", "#part", "../../../..{}/.", "mailto:a@b.org"]
_FORMS_SQL = " ".join(f"WHEN {k} THEN replace('{f}', '{{}}', h)" for k, f in enumerate(_FORMS))


@query(f"""WITH l AS (SELECT page_id, url, regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1) AS hs FROM pages),
 e AS (SELECT page_id, url, unnest(hs) AS h, unnest(range(0, len(hs))) AS k FROM l),
 r AS (SELECT *, CASE k % {len(_FORMS)} {_FORMS_SQL} END AS ref FROM e),
 s AS (SELECT *, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 2) AS host, regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 3) AS path,
   regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 4) AS query, regexp_extract(ref, '^[^?#]*') AS rp, regexp_extract(ref, '[?#].*$') AS tail FROM r),
 p AS (SELECT *, CASE WHEN rp[1:2] = '//' THEN regexp_replace(rp, '^//[^/]*', '') WHEN rp = '' THEN path WHEN rp[1] = '/' THEN rp WHEN path = '' THEN '/' || rp ELSE regexp_replace(path, '[^/]*$', '') || rp END AS joined FROM s),
 d AS (SELECT *, list_transform(string_split(joined, '/'), lambda x: [x]) AS segs FROM p),
 n AS (SELECT *, array_to_string(list_reduce(segs, lambda done, x: CASE WHEN x[1] = '.' THEN done WHEN x[1] = '..' THEN CASE WHEN len(done) > 1 THEN done[1:len(done) - 1] ELSE done END ELSE list_concat(done, x) END), '/')
   || CASE WHEN segs[-1][1] IN ('.', '..') THEN '/' ELSE '' END AS clean FROM d)
 SELECT page_id, k, CASE WHEN regexp_matches(ref, '^[a-z]+:') THEN ref ELSE scheme || '://' || CASE WHEN rp[1:2] = '//' THEN regexp_extract(rp, '^//([^/]*)', 1) ELSE host END
   || CASE WHEN rp = '' THEN path ELSE clean END || CASE WHEN rp = '' AND tail[1] IS DISTINCT FROM '?' THEN query ELSE '' END || tail END AS address FROM n""")
def absolute_links(spark, sf_dir):
    """Every link of every page, written in nine forms in turn, made absolute on its page's address."""
    l = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(links.hrefs(F.col("html"))).alias("k", "h"))
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("k") % len(_FORMS) + 1).cast("int"))
    ref = F.replace(form, F.lit("{}"), F.col("h"))
    return l.select("page_id", F.col("k").cast("long").alias("k"), links.resolve(F.col("url"), ref).alias("address"))
