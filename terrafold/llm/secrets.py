"""Secret scans: pattern kinds plus sliding-window Shannon entropy, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import common

# Fixed values of the contract.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the entropy test, and the gate of the three kinds that need a run of 20 characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WIDTH = 20
#: The entropy that a window needs, in bits a character, by the class of the candidate's characters.
BITS = {"hex": 2.9, "base64": 3.6}
#: What of a candidate is judged apart where the candidate holds an allow-listed word.
PIECE = r"[A-Za-z0-9+_-]{20,}"
#: Candidates that match ALLOWED are no secrets, nor are pieces of a candidate that match it or hold one of these: placeholders,
#: alphabets, UUIDs, long words.
ALLOW_WORDS = ("example", "placeholder", "changeme", "yoursecret", "your_", "your-", "xxxx", "0123456789", "abcdefghij", "1234567890")
ALLOWED = r"^(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[A-Za-z+/_=-]+|[0-9+/_=-]+)$"
#: c * log2(c) in millionths, for counts c of 0 to WIDTH: whole numbers, so that every engine sums them alike.
C_LOG_C = [0, *(round(c * math.log2(c) * 1e6) for c in range(1, WIDTH + 1))]


def most_c_log_c(bits: float) -> int:
    """The largest sum of c * log2(c) over a window's characters at which its entropy still reaches bits."""
    return math.floor(WIDTH * (math.log2(WIDTH) - bits) * 1e6)


#: Matches, or spans, that one fold handles: arrays grow by a copy each, so a fold over all of a text's would take their square.
FOLD = 256


def _folds(items: Column) -> Column:
    """items cut into arrays of FOLD."""
    return common.bind(items, lambda z: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(z) - 1) / FOLD)).cast("int")), lambda k: F.slice(z, k * FOLD + 1, FOLD)))


def _matches(text: Column, pattern: str, keep: Callable[[Column, Column], Column] | None = None, group: int = 0) -> Column:
    """Start, end and text of the leftmost non-overlapping matches, in code points; `group` is what keep sees.

    Matches lie between the pieces of a split by the same pattern, so lengths of pieces and matches give positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(found.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap"))
    long_of = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    kind = "array<struct<start:int,stop:int,m:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["m"]), F.lit(0))
        keeps = x["m"].isNotNull() if keep is None else x["m"].isNotNull() & keep(x["m"], x["v"])
        row = F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("m"))
        return F.struct(stop.alias("at"), F.when(keeps, F.array_append(acc["out"], row)).otherwise(acc["out"]).alias("out"))

    def within(fold: Column, at: Column) -> Column:
        return F.aggregate(fold, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    def across(folds: Column) -> Column:
        """Where each fold starts, from the lengths of those before."""
        lengths = F.transform(folds, lambda f: F.aggregate(f, F.lit(0), lambda acc, x: acc + long_of(x)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    both = lambda folds: F.arrays_zip(folds.alias("fold"), across(folds).alias("at"))
    return F.flatten(F.transform(common.bind(_folds(zipped), both), lambda p: within(p["fold"], p["at"])))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["stop"].alias("stop")))


def _hot_window(token: Column) -> Column:
    """First start and last stop of the windows of token whose entropy reaches BITS of its class; null if none does.

    A window's counts come from the window before: one character more, one less, and the sum of c * log2(c) with them.
    """
    least = F.when(token.rlike(r"^[0-9a-fA-F]+$"), F.lit(most_c_log_c(BITS["hex"]))).otherwise(F.lit(most_c_log_c(BITS["base64"])))
    table = F.array(*[F.lit(v) for v in C_LOG_C])
    zero = F.struct(
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("n"),
        F.lit(0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def of(bound: Column) -> Column:
        chars, limit, logs = bound["chars"], bound["limit"], bound["logs"]

        def shift(acc: Column, i: Column) -> Column:
            new, old = F.get(chars, i), F.when(i >= WIDTH, F.get(chars, i - WIDTH))
            count = lambda c: F.coalesce(F.try_element_at(acc["n"], c), F.lit(0))
            up, down = count(new), count(old)
            same = F.coalesce(new == old, F.lit(False))
            gone = F.when(old.isNull() | same, F.lit(0)).otherwise(F.get(logs, down) - F.get(logs, down - 1))
            total = acc["sum"] - gone + F.when(same, F.lit(0)).otherwise(F.get(logs, up + 1) - F.get(logs, up))
            rest = F.map_filter(acc["n"], lambda c, _: (c != new) & F.coalesce(c != old, F.lit(True)))
            entries = F.filter(
                F.array(F.struct(new.alias("k"), F.when(same, up).otherwise(up + 1).alias("v")), F.struct(F.coalesce(old, F.lit("")).alias("k"), (down - 1).alias("v"))),
                lambda e: (e["v"] > 0) & ((e["k"] != new) | (e["v"] > 0)) & (e["k"] != ""),
            )
            fresh = F.map_from_entries(F.when(same | old.isNull(), F.slice(entries, 1, 1)).otherwise(entries))
            hot = (i >= WIDTH - 1) & (total <= limit)
            return F.struct(
                F.map_concat(rest, fresh).alias("n"), total.alias("sum"),
                F.coalesce(acc["first"], F.when(hot, i - (WIDTH - 1))).alias("first"), F.when(hot, i + 1).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, shift)

    return common.bind(F.struct(F.split(token, "").alias("chars"), least.alias("limit"), table.alias("logs")), of)


def _placeholder(token: Column) -> Column:
    low = F.lower(token)
    return reduce(lambda a, w: a | low.contains(w), ALLOW_WORDS, F.lit(False))


def _pieces(token: Column) -> Column:
    """The candidate itself or, where it holds an allow-listed word, its pieces between slashes and equals signs that hold none."""
    inner = _matches(token["m"], PIECE, lambda m, _: ~(_placeholder(m) | m.rlike(ALLOWED)))
    moved = F.transform(inner, lambda x: F.struct((token["start"] + x["start"]).alias("start"), (token["start"] + x["stop"]).alias("stop"), x["m"].alias("m")))
    return F.when(_placeholder(token["m"]), moved).otherwise(F.array(token))


def _entropy(text: Column) -> Column:
    tokens = F.flatten(F.transform(_matches(text, CANDIDATE, lambda m, _: ~m.rlike(ALLOWED)), _pieces))
    hot = F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), _hot_window(x["m"]).alias("w")))
    return F.transform(
        F.filter(hot, lambda x: x["w"]["first"].isNotNull()),
        lambda x: F.struct((x["start"] + x["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["w"]["last"]).alias("stop")),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return common.bind(names, lambda n: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(n, s["kind"]), s["start"], s["stop"])), ","))


def _held(docs: DataFrame, text: str) -> DataFrame:
    """docs with a row's columns in _row, so that none of their names is in the way, and the text beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))


OUTPUTS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")


def _scanned(held: DataFrame) -> DataFrame:
    t = common.text_or_empty("_text")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    gated = lambda pattern, spans: F.when(t.rlike(pattern), spans).otherwise(none)
    found = {
        "_assign": gated(ASSIGN, _spans(_matches(t, ASSIGN, lambda _, v: F.length(v) >= 6, 1), 0)),
        "_access": gated(ACCESS, _spans(_matches(t, ACCESS), 1)),
        "_hex": gated(HEX, _spans(_matches(t, HEX), 2)),
        "_entropy": gated(CANDIDATE, _entropy(t)),
    }
    base = F.concat("_assign", "_access", "_hex")
    return held.withColumns(found).withColumns(
        {k: F.size(f"_{k[2:]}").cast("long") for k in ("n_assign", "n_access", "n_hex")}
        | {"base_sha256": F.sha2(_joined(base), 256), "spans": _joined(F.concat(base, F.col("_entropy"))), "found": F.array_sort(F.concat(base, F.col("_entropy")))}
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex (long), base_sha256, spans and found (the spans as start, kind, stop).

    Null and empty texts have no spans (digest of nothing). A candidate of the entropy test that holds an allow-listed word is
    judged by its pieces between slashes and equals signs, so such a word beside a key does not hide it. Spans of different kinds may overlap; all stay. Other columns and
    the number of rows, repeated ones included, stay; columns of docs with one of these six names are replaced.
    """
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in OUTPUTS]
    return _scanned(_held(docs, text)).select(*kept, *OUTPUTS)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of scan() in the text replaced by mark; overlapping spans give one mark.

    Null text stays null, rows and all other columns stay as they are, whatever their names.
    """
    t = F.col("_text")
    parts = F.array().cast("array<string>")

    def within(fold: Column, at: Column, segment: Column) -> Column:
        """The text of segment, which starts at `at`, with marks for the spans of the fold."""

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(segment, acc["at"] - at + 1, s["start"] - acc["at"])
            out = F.when(s["start"] >= acc["at"], F.array_append(F.array_append(acc["out"], gap), F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

        return F.aggregate(fold, F.struct(at.alias("at"), parts.alias("out")), step, lambda acc: F.array_join(acc["out"], ""))

    def across(acc: Column, fold: Column) -> Column:
        stop = F.greatest(acc["at"], F.array_max(F.transform(fold, lambda s: s["stop"])))
        bound = F.struct(fold.alias("fold"), acc["at"].alias("at"), F.substring(t, acc["at"] + 1, stop - acc["at"]).alias("segment"))
        more = common.bind(bound, lambda b: within(b["fold"], b["at"], b["segment"]))
        return F.struct(stop.alias("at"), F.array_append(acc["out"], more).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), parts.alias("out"))
    clean = F.aggregate(_folds(F.col("found")), zero, across, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    clean = F.when(F.size("found") > 0, clean).otherwise(t)
    return _scanned(_held(docs, text)).select(*[clean.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def pieces(name: str, pattern: str, group: int = 0) -> str:
        p = quoted(pattern)
        return f"regexp_extract_all(t, {p}, 0) AS m_{name}, regexp_extract_all(t, {p}, {group}) AS v_{name}, string_split_regex(t, {p}) AS g_{name}"

    def rows(name: str, kind: int | str, keep: str, source: str = "p") -> str:
        start = f"CAST(list_sum(list_transform(g_{name}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m_{name}[1:i-1], lambda x: length(x))), 0) AS BIGINT)"
        return f"SELECT rid, {kind} AS kind, {start} AS start, {start} + length(m_{name}[i]) AS stop, m_{name}[i] AS m FROM (SELECT *, unnest(range(1, len(m_{name}) + 1)) AS i FROM {source}) WHERE {keep}"

    words = " OR ".join(f"contains(lower(m), '{w}')" for w in ALLOW_WORDS)
    logs = "[" + ", ".join(map(str, C_LOG_C)) + "]"
    limit = f"CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN {most_c_log_c(BITS['hex'])} ELSE {most_c_log_c(BITS['base64'])} END"
    joined = lambda where: f"coalesce(string_agg(CASE WHEN {where} THEN name || ':' || start || ':' || stop END, ',' ORDER BY start, kind, stop), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT rid, {pieces('a', ASSIGN, 1)}, {pieces('k', ACCESS)}, {pieces('h', HEX)}, {pieces('c', CANDIDATE)} FROM d),
cand AS (SELECT rid, start, m, {words} AS held FROM ({rows('c', 3, 'true')}) WHERE NOT regexp_matches(m, {quoted(ALLOWED)})),
cut AS (SELECT rid, start AS began, regexp_extract_all(m, {quoted(PIECE)}, 0) AS m_c, string_split_regex(m, {quoted(PIECE)}) AS g_c FROM cand WHERE held),
piece AS (SELECT rid, kind + start AS start, m FROM ({rows('c', 'began', 'true', 'cut')})
          WHERE NOT regexp_matches(m, {quoted(ALLOWED)}) AND NOT ({words})),
win AS (SELECT rid, start, m, unnest(range(1, length(m) - {WIDTH} + 2)) AS w FROM (
        SELECT rid, start, m FROM cand WHERE NOT held UNION ALL SELECT rid, start, m FROM piece)),
hot AS (SELECT rid, start, m, w FROM (
          SELECT rid, start, m, w, ch, count(*) AS n FROM (SELECT *, unnest(string_split(substr(m, w, {WIDTH}), '')) AS ch FROM win) GROUP BY ALL)
        GROUP BY rid, start, m, w HAVING sum({logs}[n + 1]) <= any_value({limit})),
s AS (SELECT rid, kind, start, stop FROM ({rows('a', 0, 'length(v_a[i]) >= 6')})
      UNION ALL SELECT rid, kind, start, stop FROM ({rows('k', 1, 'true')})
      UNION ALL SELECT rid, kind, start, stop FROM ({rows('h', 2, 'true')})
      UNION ALL SELECT rid, 3, start + min(w) - 1, start + max(w) + {WIDTH - 1} FROM hot GROUP BY rid, start, m),
n AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] AS name FROM s)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256({joined('kind < 3')}) AS base_sha256, {joined('true')} AS spans
FROM d LEFT JOIN n USING (rid) GROUP BY rid, doc_id
"""


ORACLE = _oracle()
