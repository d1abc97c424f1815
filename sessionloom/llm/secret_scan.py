"""Secret scan with multipart credential linking, in DataFrame functions only.

Three base kinds are reported wherever they match. Three weak kinds (account
identifiers, unnamed mixed-case secrets, endpoints) are parts of a credential
and reported only when complementary parts lie within ``SCOPE`` code points:
an identifier near a secret, a secret near an identifier, an endpoint near
both. Base access keys count as identifiers, base assignments and hex runs as
secrets.

Positions come from the lengths of the texts between the matches. The parts
of a document are joined by interval: each part is dealt to the stretches of
``STRETCH`` code points that its scope touches, and within a stretch the
nearest complementary part before and after is found by running maxima and
minima, so that no pairs are made and no group is larger than a stretch. What
a part meets in any of its stretches counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import fresh, materialize

#: Name, pattern, least length of the whole match or of group 2, in reported order.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]{24,}", 24),
)
WEAK = (
    ("ident", r"""(?i:client_?id|access_?id|user_?name|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", 0),
    ("secret", r"[A-Za-z0-9+/]{30,}", 30),
    ("endpoint", r"""(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+""", 0),
)
KINDS = tuple(k[0] for k in (*BASE, *WEAK))
SCOPE = 200
STRETCH = 4096
#: Code points of the pieces that a text is cut into before spans are masked.
PIECE = 1024


def _spans(text: Column, kind: int, pattern: str, least: int) -> Column:
    """Array of (kind, gap before, length, ok) of leftmost non-overlapping matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if KINDS[kind] == "assign":
        ok = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x) >= least)
    elif KINDS[kind] == "secret":  # mixed case with a digit: neither a word nor a plain digest
        ok = F.transform(whole, lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]"))
    else:
        ok = F.transform(whole, lambda x: F.length(x) >= least)
    gaps = F.split(text, pattern, -1)
    one = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("match"), ok.alias("ok")), lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["match"]), F.lit(0)).alias("len"), F.coalesce(x["ok"], F.lit(False)).alias("ok")))
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), one).otherwise(none)


def _positions(scanned: DataFrame, key: list[str]) -> DataFrame:
    """One row (key, kind, start, end) for each accepted match."""
    each = scanned.filter(F.size("found") > 0).dropDuplicates(key).select(*key, F.posexplode("found").alias("i", "m"))
    w = W.partitionBy(*key, "m.kind").orderBy("i")
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.len")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return each.select(*key, F.col("m.kind").alias("kind"), (end - F.col("m.len")).alias("start"), end.alias("end"), F.col("m.ok").alias("ok")).filter("ok").drop("ok")


def _linked(parts: DataFrame, key: list[str], scope: int) -> DataFrame:
    """The base spans, and those weak ones whose complementary parts lie within ``scope``."""
    n_base = len(BASE)
    role = F.when(F.col("kind").isin(1, 3), "i").when(F.col("kind").isin(0, 2, 4), "s").otherwise("e")
    reach = F.sequence(F.floor((F.col("start") - scope) / STRETCH), F.floor((F.col("end") + scope) / STRETCH))
    dealt = parts.withColumn("role", role).withColumn("stretch", F.explode(reach))
    by = W.partitionBy(*key, "stretch").orderBy("start", "kind", "end")
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(1, W.unboundedFollowing)

    def near(of: Column) -> Column:
        return F.coalesce(F.max(F.when(of, F.col("end"))).over(before) >= F.col("start") - scope, F.lit(False)) | F.coalesce(F.min(F.when(of, F.col("start"))).over(after) <= F.col("end") + scope, F.lit(False))

    base = F.col("kind") < n_base
    covered = F.coalesce(F.max(F.when(base, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    seen = dealt.select("*", near(F.col("role") == "i").alias("near_i"), near(F.col("role") == "s").alias("near_s"), covered.alias("covered"))
    wanted = F.when(F.col("role") == "i", F.col("near_s")).when(F.col("role") == "s", F.col("near_i")).otherwise(F.col("near_i") & F.col("near_s"))
    # a part may meet its complement, or a base span that covers it, in any of its stretches
    judged = seen.groupBy(*key, "kind", "start", "end", "role").agg(*(F.bool_or(c).alias(c) for c in ("near_i", "near_s", "covered")))
    return judged.filter(base | (wanted & ~F.col("covered"))).select(*key, "kind", "start", "end")


def _keyed(docs: DataFrame, id_col: str, text_col: str, h1: str, h2: str) -> DataFrame:
    """``docs`` with two hashes that, next to the id, tell its texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({h1: F.xxhash64(F.lit(1), text), h2: F.xxhash64(F.lit(2), text)})


def _join_spans(keyed: DataFrame, per: DataFrame, id_col: str, h1: str, h2: str, spans: str) -> DataFrame:
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,before:bigint>>")
    per = per.toDF("ss_join_id", "ss_join_1", "ss_join_2", spans)
    on = keyed[id_col].eqNullSafe(per["ss_join_id"]) & (keyed[h1] == per["ss_join_1"]) & (keyed[h2] == per["ss_join_2"])
    return keyed.join(per, on, "left").drop("ss_join_id", "ss_join_1", "ss_join_2").withColumn(spans, F.coalesce(F.col(spans), none))


def _scan(docs: DataFrame, scope: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Keys of all rows, and the spans of those keys that have any."""
    key = ["doc_id", "h1", "h2"]
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(_spans(text, i, p, n) for i, (_, p, n) in enumerate((*BASE, *WEAK)))).alias("found")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = materialize(_keyed(plain, "doc_id", "text", "h1", "h2").select(*key, found))
    linked = _linked(_positions(scanned, key), key, scope)
    before = F.max("end").over(W.partitionBy(*key).orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, -1))
    linked = linked.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
    return scanned.select(*key), linked.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "before"))).alias("spans"))


def secret_spans(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_linked`` and ``spans``.

    ``spans`` is an array of (start, kind, end, before), code points with an
    exclusive end, sorted by start, then kind as listed in ``KINDS``; kinds
    from ``len(BASE)`` on are linked weak parts, which never overlap a base
    span; ``before`` is the greatest end of the spans before, 0 if none.

    A null or empty text has no spans. Repeated rows each give a row; rows
    that share an id, null included, are told apart by their texts. Other
    columns are not used, so their names can't clash. An empty table gives an
    empty result.
    """
    keys, per = _scan(docs, scope, id_col, text_col)
    joined = _join_spans(keys, per, "doc_id", "h1", "h2", "spans")
    count = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    return joined.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size(F.filter("spans", lambda x: x["kind"] >= len(BASE))).cast("long").alias("n_linked"), "spans")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span of ``text_col`` replaced by ``[kind]``; a span that overlaps the one before joins it.

    Rows and columns stay as they are; a null text stays null. Cases are as in
    ``secret_spans``.
    """
    h1, h2, spans = fresh(docs, "ss_h1", "ss_h2", "ss_spans")
    _, per = _scan(docs, scope, id_col, text_col)
    joined = _join_spans(_keyed(docs, id_col, text_col, h1, h2), per, id_col, h1, h2, spans)
    text = F.col(text_col)
    kinds = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    pieces = fresh(joined, "ss_pieces")[0]
    joined = joined.withColumn(pieces, F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def cut(start: Column, end: Column) -> Column:
        """Code points from start to end, by the pieces they lie in: a long text isn't walked through once for each span."""
        first = F.floor(start / PIECE)
        held = F.array_join(F.slice(pieces, (first + 1).cast("int"), (F.floor((end - 1) / PIECE) - first + 1).cast("int")), "")
        return F.when(end > start, F.substring(held, (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    apart = F.filter(spans, lambda x: x["start"] >= x["before"])
    told = F.transform(apart, lambda x: F.concat(cut(x["before"], x["start"]), F.element_at(kinds, x["kind"] + 1)))
    tail = cut(F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text).cast("long"))
    masked = F.concat(F.array_join(told, ""), tail)
    return joined.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).select(*docs.columns)
