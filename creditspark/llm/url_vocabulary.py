"""URL filter by a weighted vocabulary: one Aho-Corasick pass finds strict and soft terms.

An occurrence counts only between word boundaries (neither neighbor is a letter a-z or
a digit). A URL is rejected for one strict term, or when its distinct soft terms are
several and weigh enough together.

Defined results: null or empty URLs have no term and are allowed by the method; case is
ignored (A-Z only); repeated rows are judged alike; an empty table gives an
empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm import flat
from creditspark.llm.registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRICT = ("porn", "xxx", "viagra", "casino", "escort", "warez", "cheap-pills", "spam-farm")
SOFT = {"adult": 1.0, "sex": 1.0, "nude": 1.0, "cam": 0.5, "pills": 1.0, "cheap": 0.5, "spam": 1.0, "farm": 0.5, "bet": 0.5,
        "poker": 1.0, "loan": 0.5, "free": 0.5, "click": 0.5, "win": 0.5, "torrent": 1.0, "crack": 1.0}
MIN_TERMS, MIN_WEIGHT = 2, 1.5
ADDED = "n_strict int, n_soft int, soft_weight double, rejected boolean"
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]):
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def found_terms(url: str, automaton) -> list[str]:
    """Terms at word boundaries, one entry per occurrence."""
    s, out = url.translate(_FOLD), []
    for last, term in automaton.iter(s):
        first = last - len(term) + 1
        if (first == 0 or s[first - 1] not in _ALNUM) and (last + 1 == len(s) or s[last + 1] not in _ALNUM):
            out.append(term)
    return out


_FOLD = str.maketrans(UPPER, LOWER)


def score_urls(df: DataFrame, url: str = "url", strict: Sequence[str] = STRICT, soft: Mapping[str, float] = SOFT,
               min_terms: int = MIN_TERMS, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """Add the term counts and the method's decision to each row."""
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(ADDED).fields)
    strict_set, weights = frozenset(strict), dict(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(tuple(sorted(strict_set | set(weights))))
        for batch in batches:
            added = [[], [], [], []]
            for u in flat.pylist(batch, url):
                terms = found_terms(u, automaton) if u else []
                n_strict, kinds = sum(t in strict_set for t in terms), {t for t in terms if t in weights}
                total = sum(weights[t] for t in sorted(kinds))
                for values, v in zip(added, (n_strict, len(kinds), float(total), n_strict > 0 or (len(kinds) >= min_terms and total >= min_weight))):
                    values.append(v)
            types = (pa.int32(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(v, t) for v, t in zip(added, types)], names=schema.names)

    return df.mapInArrow(run, schema)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.regexp_replace(after, "^[^/?#]*", ""), "^[^?#]*", 0)


#: Contract rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _term_sql(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


_SOFT_N = " + ".join(f"CAST({_term_sql(t)} AS INT)" for t in SOFT)
_SOFT_W = " + ".join(f"CASE WHEN {_term_sql(t)} THEN {w} ELSE 0 END" for t, w in SOFT.items())
_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
                 for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
_GIVEN = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)
ORACLE_SQL = f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT *, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (
  SELECT *, CASE {_FITS} END AS rule, {' OR '.join(map(_term_sql, STRICT))} AS strict_hit, {_SOFT_N} AS n_soft, {_SOFT_W} AS w FROM c)
SELECT page_id, host, path, rule,
  coalesce(CASE rule {_GIVEN} END, CASE WHEN strict_hit OR (n_soft >= {MIN_TERMS} AND w >= {MIN_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict
FROM d"""


@query("op3_url_vocabulary", ORACLE_SQL)
def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, fitting rule and verdict."""
    scored = score_urls(table(spark, sf_dir, "pages", "page_id", "url"))
    host, path = host_and_path(F.col("url"))
    rule, given = match_rules(F.col("host"), F.col("path"), RULES)
    method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumns({"host": host, "path": path}).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(given, method).alias("verdict"))
