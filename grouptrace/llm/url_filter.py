"""URL filters: exact lists of rules and names held in Bloom filter cascades.

Level 1 of a cascade encodes the listed keys; level 2 the other keys of the universe that level 1 takes for listed; level 3
the listed keys that level 2 takes for those; and so on until a level has no false positives. The first level that
rejects a key tells whether it is listed, without error for every key of the universe, which is all the keys that the
corpus can ask for. Lookups need no join: a cascade is a few bits per listed key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grouptrace.llm import words
from grouptrace.session import materialize

#: More listed keys than this are refused: their cascade would no longer be small enough to send to every task.
MOST_LISTED = 10_000_000
_MOST_HASHES = 64

# The rules, and the names whose hosts are listed.
BLOCK_RULES = ("net/", "example.com/de/")
ALLOW_RULES = ("example.net/en/", "org/fr/")
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def _hashes(column: pa.Array) -> np.ndarray:
    """64-bit hashes of whole keys."""
    parts = []
    for _, data, bounds in words.chunks(column):
        parts.append(words.range_hash(data, bounds[:-1], bounds[1:]))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _places(level: int, hashes: int, n_bits: int, key: np.ndarray):
    """The bits of each key in a level, one array for each hash function."""
    for k in range(hashes):
        salt = words.mix(np.array([level * _MOST_HASHES + k + 1], dtype=np.uint64))
        yield (words.mix(key ^ salt) % words.U(n_bits)).astype(np.int64)


@dataclass
class Cascade:
    """levels: (bits, hash functions, number of bits); the first, third, ... encode listed keys, the others keys that aren't."""

    levels: list[tuple[np.ndarray, int, int]]

    def add(self, key: np.ndarray, hashes: int) -> None:
        """A level for some keys; at 1.44 bits for each key and hash, one in 2**hashes other keys passes it."""
        bits = np.zeros(max(64, math.ceil(1.44 * len(key) * hashes)), dtype=np.uint8)
        for at in _places(len(self.levels), hashes, len(bits), key):
            bits[at] = 1
        self.levels.append((np.packbits(bits), hashes, len(bits)))

    def within(self, level: int, key: np.ndarray) -> np.ndarray:
        packed, hashes, n_bits = self.levels[level]
        found = np.ones(len(key), dtype=bool)
        for at in _places(level, hashes, n_bits, key):
            found &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found

    def listed(self, key: np.ndarray) -> np.ndarray:
        """For each hash: does the first level that rejects it encode unlisted keys?"""
        out = np.zeros(len(key), dtype=bool)
        undecided = np.arange(len(key))
        for level in range(len(self.levels)):
            inside = self.within(level, key[undecided])
            out[undecided[~inside]] = level % 2 == 1
            undecided = undecided[inside]
        out[undecided] = len(self.levels) % 2 == 1
        return out


def _listed_hashes(listed: Iterable[str] | DataFrame) -> np.ndarray:
    """Distinct hashes of listed keys; of a table its first column, whose keys are hashed where they lie."""
    if not isinstance(listed, DataFrame):
        return np.unique(_hashes(pa.array(sorted(set(listed)), pa.string())))

    def hashed(batches):
        for batch in batches:
            key = np.unique(_hashes(batch.column("key").drop_null()))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    keys = listed.select(F.col(listed.columns[0]).alias("key")).mapInArrow(hashed, "key long").distinct()
    return np.sort(keys.limit(MOST_LISTED + 1).toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def cascade(universe: DataFrame, listed: Iterable[str] | DataFrame) -> Cascade:
    """The cascade of the listed keys, or of a table's first column, over a universe of distinct keys (column key).

    Level 1 lets about as many other keys pass as there are listed ones; Spark finds these, and only their hashes come
    to the driver. Every further level lets half of its other side pass, so levels halve. A cascade therefore takes a few
    bits for each listed key and each doubling of the universe. A listed key needn't be in the universe.
    """
    own = _listed_hashes(listed)
    if len(own) > MOST_LISTED:
        raise ValueError(f"{len(own)} listed keys; at most {MOST_LISTED} fit a cascade")
    spark = universe.sparkSession
    levels = Cascade([])
    levels.add(own, max(1, math.ceil(math.log2(max(1, universe.count()) / max(1, len(own)) + 1))))
    shared = spark.sparkContext.broadcast((levels, own))

    def wrong(batches):
        for batch in batches:
            first, members = shared.value
            key = np.unique(_hashes(batch.column("key")))
            key = key[first.within(0, key)]
            key = key[~np.isin(key, members, assume_unique=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    passed = universe.select("key").mapInArrow(wrong, "key long").distinct().limit(2 * MOST_LISTED + 1).toPandas()["key"]
    if len(passed) > 2 * MOST_LISTED:
        raise ValueError("the first level lets too many other keys pass")
    sides = [own, passed.to_numpy(np.int64).view(np.uint64)]
    level = 1
    while len(sides[level % 2]):
        levels.add(sides[level % 2], 1)
        other = sides[(level + 1) % 2]
        sides[(level + 1) % 2] = other[levels.within(level, other)]
        level += 1
    return levels


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz",
    )


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _prefixes(text: str, depth: int) -> list[str]:
    """The path's beginnings that end with a slash, down to the depth of the deepest rule; without a path, none."""
    out, at = [], -1
    while len(out) < depth and (at := text.find("/", at + 1)) >= 0:
        out.append(text[: at + 1])
    return out


def _suffixes(name: str) -> list[str]:
    """The host and all domains above it."""
    labels = name.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))] if name else []


def rule_keys(hosts: list[str], paths: list[str], depth: int) -> list[list[str]]:
    """Per url every key that a rule could have for it, longest host first, then longest path."""
    return [
        [domain + p for domain in _suffixes(h) for p in reversed(_prefixes(t, depth))] for h, t in zip(hosts, paths)
    ]


def _candidates(parts: DataFrame, depth: int) -> DataFrame:
    """(key): the rule keys of all urls, thinned per batch."""

    def expand(batches):
        for batch in batches:
            keys = rule_keys(batch.column("host").to_pylist(), batch.column("path").to_pylist(), depth)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sorted({k for own in keys for k in own}), pa.string())], names=["key"])

    return parts.select("host", "path").mapInArrow(expand, "key string")


def _deepest(rules: Iterable[str] | DataFrame) -> int:
    """The most slashes in a rule, after a look at the form of all of them."""
    if isinstance(rules, DataFrame):
        rule = F.col(rules.columns[0])
        odd = rules.where(~rule.endswith("/") | rule.startswith("/")).select(rule).limit(1).collect()
        deepest = rules.agg(F.max(F.length(rule) - F.length(F.replace(rule, F.lit("/"), F.lit(""))))).first()[0] or 0
    else:
        odd = [(rule,) for rule in rules if not rule.endswith("/") or rule.startswith("/")]
        deepest = max((rule.count("/") for rule in rules), default=0)
    if odd:
        raise ValueError(f"a rule is a host and a path that ends with a slash: {odd[0][0]!r}")
    return deepest


def judged(
    pages: DataFrame, block: tuple[str, ...] | DataFrame, allow: tuple[str, ...] | DataFrame,
    listed_names: Iterable[str] | DataFrame = (), url_column: str = "url",
) -> DataFrame:
    """(row, host, path, rule, verdict) per row of pages, whose own columns are in row.

    A rule is a host and a path joined; it fits its host and all subdomains if the url's path starts with its own, where
    both end at a slash. The longest fitting rule decides (host and path together; a block wins a tie).
    Where none fits, the url is blocked if a label of its host is a listed
    name, else allowed. A null url, or one without ://, has an empty
    host and path, which no rule fits, and is allowed. An empty table gives an empty result; rows are judged alone, so
    repeats don't matter. Rules and names may be tables, whose first column is read.
    """
    depth = max(_deepest(block), _deepest(allow))
    url = F.col(f"row.{url_column}")
    parts = pages.select(F.struct("*").alias("row")).select("row", host(url).alias("host"), path(url).alias("path"))
    keys = materialize(_candidates(parts, depth).distinct(), "rule-keys")
    labels = parts.select("host").distinct().select(F.explode(F.split("host", "[.]")).alias("key")).distinct()
    labels = materialize(labels, "labels")
    cascades = [cascade(keys, block), cascade(keys, allow), cascade(labels, listed_names)]
    shared = pages.sparkSession.sparkContext.broadcast(cascades)

    def judge(batches):
        for batch in batches:
            blocked, allowed, listed = shared.value
            names = batch.column("host")
            keys = rule_keys(names.to_pylist(), batch.column("path").to_pylist(), depth)
            flat = pa.array([k for own in keys for k in own], pa.string())
            hashes = _hashes(flat)
            hit, fine = blocked.listed(hashes), allowed.listed(hashes)
            labels = [h.split(".") for h in names.to_pylist()]
            of = np.repeat(np.arange(len(labels)), [len(x) for x in labels])
            bad = listed.listed(_hashes(pa.array([x for own in labels for x in own], pa.string())))
            bad_host = np.bincount(of[bad], minlength=len(labels)) > 0
            rules, verdicts, at = [], [], 0
            for i, own in enumerate(keys):
                best = None
                for k, key in enumerate(own, at):
                    if (hit[k] or fine[k]) and (best is None or len(key) > len(best[0])):
                        best = (key, "block" if hit[k] else "allow")
                at += len(own)
                rules.append(best[0] if best else None)
                verdicts.append(best[1] if best else "block" if bad_host[i] else "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), names, batch.column("path"), pa.array(rules, pa.string()),
                 pa.array(verdicts, pa.string())],
                names=["row", "host", "path", "rule", "verdict"],
            )

    schema = f"row {parts.schema['row'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return parts.mapInArrow(judge, schema)


ORACLE_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule, domain, start, verdict) AS (
  VALUES {", ".join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{v}')"
                    for rules, v in ((BLOCK_RULES, "block"), (ALLOW_RULES, "allow")) for r in rules)}
), fitting AS (
  SELECT page_id, rule, verdict FROM parts JOIN rules
    ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN list_has_any(string_split(host, '.'), [{", ".join(f"'{n}'" for n in LISTED_NAMES)}])
    THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitting USING (page_id)
"""
