"""URL rules by a Bloom filter cascade, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import materialize

#: (verdict, host, path) of the production list.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: A level passes about this share of the keys that it must not hold; each level shrinks what the next one encodes.
LEVEL_FPP = 0.01
#: Look-ups of a key in a level of few keys, whose least size leaves room for them.
PROBES = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits, eight a byte, as one binary constant of the plan, 1.2 bytes for each key it encodes."""

    bits: bytes
    probes: int
    seed: int

    def holds(self, key: Column) -> Column:
        own = F.lit(self.bits)
        byte = lambda at: F.conv(F.hex(F.substring(own, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        one = lambda at: F.call_function("getbit", byte(at), at.bitwiseAND(F.lit(7)).cast("int")) == 1
        return F.forall(F.array(*bit_positions(key, len(self.bits) * 8, self.probes, self.seed)), one)


def bit_positions(key: Column, bits: int, probes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits).cast("long")) for i in range(probes)]


def build_level(keys: DataFrame, n: int, seed: int, fpp: float = LEVEL_FPP) -> Level:
    """A filter over keys(key): partitions or their own words together, so that the driver gets the words only."""
    bits = max(64, 64 * math.ceil(-n * math.log(fpp) / math.log(2) ** 2 / 64))
    probes = max(1, round(bits / max(1, n) * math.log(2))) if n * 20 > bits else PROBES
    found = keys.select(F.explode(F.array(*bit_positions(F.col("key"), bits, probes, seed))).alias("at"))
    words = found.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v"))
    out = bytearray(bits // 8)
    for row in words.toLocalIterator():
        out[row["w"] * 8 : row["w"] * 8 + 8] = (row["v"] & (1 << 64) - 1).to_bytes(8, "little")
    return Level(bytes(out), probes, seed)


class Cascade:
    """Exact membership in a list for every key of a known universe.

    Level 1 encodes the listed keys, level 2 the keys of the universe that pass level 1 and aren't listed,
    level 3 the listed keys that pass level 2, and so on until a level lets nothing wrong through. The first level
    that doesn't hold a key decides: at an even level the key is listed, at an odd one it isn't. No join takes part:
    what passes level 1 and isn't listed is told by an aggregate over both.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, tag: str):
        self.levels: list[Level] = []
        inside = listed.select("key").distinct()
        n_in = inside.count()
        if not n_in:
            return
        # Few keys pass a tight first level; only they are kept, and only they shuffle.
        first = build_level(inside, n_in, seed=1)
        self.levels.append(first)
        passed = universe.where(first.holds(F.col("key"))).select("key", F.lit(False).alias("own"))
        told = passed.unionByName(inside.withColumn("own", F.lit(True))).groupBy("key").agg(F.bool_or("own").alias("own"))
        false = materialize(told.where("not own").select("key"), f"{tag}-false")
        sides, turn = [inside, false], 1
        while n := sides[turn].count():  # each level passes one key in a hundred on to the next
            level = build_level(sides[turn], n, seed=len(self.levels) + 1)
            self.levels.append(level)
            sides[1 - turn] = sides[1 - turn].where(level.holds(F.col("key")))
            turn = 1 - turn

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quote(v)}, {quote(h)}, {quote(p)})" for v, h, p in rules)
    return spark.sql(f"SELECT verdict, host, path, concat(host, path) AS key FROM VALUES {rows} AS t(verdict, host, path)")


def candidate_keys(host: Column, path: Column, lengths: list[tuple[int, int]]) -> Column:
    """Keys that a rule for this url could have, longest first, then longest host: host suffixes at label ends x path prefixes.

    lengths: (host, path) of the rules. A key is tried for each pair of lengths that a rule has, in one expression, so
    neither a long url nor a long list makes a long plan.
    """
    pairs = sorted(set(lengths), key=lambda x: (-(x[0] + x[1]), -x[0]))
    column = lambda k: F.expr(f"array({', '.join(str(pair[k]) for pair in pairs)})")
    prefixes = column(1)

    def key(h: Column, i: Column) -> Column:
        p = F.get(prefixes, i)
        ends = (F.length(host) == h) | ((F.length(host) > h) & (F.substring(host, -(h + 1), F.lit(1)) == "."))
        tail = F.when(h > 0, F.substring(host, -h, h)).otherwise(F.lit(""))
        return F.when(ends & (F.length(path) >= p), F.concat(tail, F.substring(path, F.lit(1), p)))

    return F.filter(F.transform(column(0), key), lambda k: k.isNotNull())


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with __host, __path, __rule and __verdict.

    Each url's verdict is that of its longest fitting rule (ties: the longest host), else default: what no cascade
    lists isn't blocked. A null url, one without :// and an empty one have empty host and path and fit no rule; long
    urls are judged whole. Repeated rows are judged each for itself. Columns of pages with the names of the four that
    are added are replaced. An empty rule list or table is fine. Rules that differ in the verdict only: block wins.
    """
    spark, rules = pages.sparkSession, RULES if rules is None else rules
    pages = pages.drop("__host", "__path", "__rule", "__verdict")
    parts = pages.withColumn("__host", url_host(F.col(url_col))).withColumn("__path", url_path(F.col(url_col)))
    if not rules:
        return parts.withColumn("__rule", F.lit(None).cast("string")).withColumn("__verdict", F.lit(default))
    listed = rule_table(spark, rules)
    keys = candidate_keys(F.col("__host"), F.col("__path"), [(len(h), len(p)) for _, h, p in rules])
    universe = parts.select(F.explode(keys).alias("key"))
    blocked = Cascade(listed.where("verdict = 'block'"), universe, "block")
    allowed = Cascade(listed.where("verdict = 'allow'"), universe, "allow")
    fits = F.filter(keys, lambda k: blocked.contains(k) | allowed.contains(k))
    return parts.withColumn("__rule", F.get(fits, F.lit(0))).withColumn("__verdict", F.when(F.col("__rule").isNull(), F.lit(default)).when(blocked.contains(F.col("__rule")), F.lit("block")).otherwise(F.lit("allow")))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (
  SELECT p.page_id, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f ON p.page_id = f.page_id AND f.n = 1
"""
