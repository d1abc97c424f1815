"""Executed checks: contracts of JSON documents, leak markers, a scorecard."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Data classes from least to most open.
LATTICE = {"raw": 0, "redacted": 1, "review": 2, "corpus": 3, "published": 4}
#: Blocks of leak markers without an inner word.
SHORT_BLOCKS = 16


def check_document(df: DataFrame, column: str, required: dict[str, str], allowed: list[str] | None = None) -> DataFrame:
    """``df`` with ``valid_json``, ``missing_key``, ``wrong_type`` and ``extra_key`` of an object in ``column``.

    ``required`` maps keys to integer, number, string, boolean, array or
    object; an integer may be written as 1.0.
    """
    patterns = {"integer": r"^-?[0-9]+(\.0+)?$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$", "boolean": "^(true|false)$", "array": r"^\[", "object": r"^\{"}
    doc = F.try_parse_json(column)
    shape = F.schema_of_variant(doc)
    valid = doc.isNotNull() & F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    get = lambda k: F.get_json_object(column, f"$.{k}")
    missing = reduce(lambda a, b: a | b, [get(k).isNull() for k in required])

    def wrong(k: str, t: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{k}", "variant"))
        return F.coalesce(kind != "STRING", F.lit(False)) if t == "string" else F.coalesce(~get(k).rlike(patterns[t]) | (kind == "STRING"), F.lit(False))

    wrongs = reduce(lambda a, b: a | b, [wrong(k, t) for k, t in required.items()])
    extra = F.size(F.array_except(F.json_object_keys(column), F.array(*map(F.lit, allowed if allowed is not None else required)))) > 0
    no = F.lit(False)
    return df.withColumns({"valid_json": F.coalesce(valid, no), "missing_key": F.coalesce(valid & missing, no), "wrong_type": F.coalesce(valid & wrongs, no), "extra_key": F.coalesce(valid & extra, no)})


_JSON_TYPES = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}


def schema_violations(v: Column, schema: dict, at: str = "$") -> Column:
    """Array of what a variant breaks of a JSON schema: type, const, enum, required, properties, additionalProperties and items.

    Each is ``path: rule``; ``[]`` stands for any item of an array. Numbers
    are compared by value and 1.0 is an integer. What a value of another type
    holds is not looked at. Every value is bound once: an expression that is
    repeated at each use would parse its text anew for each rule.
    """
    return F.flatten(F.transform(F.array(v), lambda x: F.flatten(F.transform(F.array(F.schema_of_variant(x)), lambda kind: _violations(x, kind, schema, at)))))


def _violations(v: Column, kind: Column, schema: dict, at: str) -> Column:
    number = F.try_variant_get(v, "$", "double")
    numeric = F.coalesce(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    whole = numeric & (number == F.floor(number))
    none = F.array().cast("array<string>")
    broken = lambda ok, rule: F.when(~F.coalesce(ok, F.lit(False)), F.array(F.lit(f"{at}: {rule}"))).otherwise(none)

    def is_type(name: str) -> Column:
        return whole if name == "integer" else numeric if name == "number" else F.coalesce(kind.startswith(_JSON_TYPES[name]), F.lit(False))

    def equals(value: object) -> Column:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return numeric & (number == F.lit(float(value)))
        return F.coalesce(F.to_json(v) == F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False)), F.lit(False))

    parts, inside = [], []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        parts.append(broken(reduce(lambda a, b: a | b, map(is_type, names)), "type"))
    if "const" in schema:
        parts.append(broken(equals(schema["const"]), "const"))
    if "enum" in schema:
        numbers = [x for x in schema["enum"] if isinstance(x, (int, float)) and not isinstance(x, bool)]
        others = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"] if x not in numbers or isinstance(x, bool)]
        parts.append(broken(reduce(lambda a, b: a | b, map(equals, numbers), F.coalesce(F.to_json(v).isin(others), F.lit(False)) if others else F.lit(False)), "enum"))
    an_object, an_array = is_type("object"), is_type("array")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    for k in schema.get("required", ()):
        inside.append(F.when(get(k).isNull(), F.array(F.lit(f"{at}.{k}: required"))).otherwise(none))
    for k, inner in schema.get("properties", {}).items():
        inside.append(F.when(get(k).isNotNull(), schema_violations(get(k), inner, f"{at}.{k}")).otherwise(none))
    if schema.get("additionalProperties") is False:
        extra = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, schema.get("properties", {"": 0}))))
        inside.append(F.transform(extra, lambda k: F.concat(F.lit(f"{at}."), k, F.lit(": additional"))))
    if inside:
        parts.append(F.when(an_object, F.concat(*inside)).otherwise(none))
    if "items" in schema:
        items = F.try_variant_get(v, "$", "array<variant>")
        parts.append(F.when(an_array, F.flatten(F.transform(items, lambda x: schema_violations(x, schema["items"], f"{at}[]")))).otherwise(none))
    return F.concat(*parts) if parts else none


def session_problem(version: str, source: str) -> Column:
    """The first thing wrong with a session row (schema_version, session_id, source, turns, tool_calls, file_changes, commands), null if none."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad = lambda array, on: F.array_position(F.transform(array, lambda x: F.coalesce(on(x), F.lit(True))), True) - 1
    out = F.when(F.trim(F.coalesce("schema_version", F.lit(""))) != version, "unsupported schema_version").when(blank(F.col("session_id")), "missing session_id").when(F.trim(F.coalesce("source", F.lit(""))) != source, "unsupported source")
    for c in ("turns", "tool_calls", "file_changes", "commands"):
        out = out.when(F.col(c).isNull(), f"missing {c}")
    role = bad("turns", lambda x: ~x["role"].isin("user", "assistant"))
    out = out.when(role >= 0, F.concat(F.lit("unsupported turns["), role.cast("string"), F.lit("].role")))
    gaps = F.transform("tool_calls", lambda x: F.when(blank(x["tool_call_id"]), "tool_call_id").when(blank(x["name"]), "name").when(x["input"].isNull(), "input"))
    first = F.array_position(F.transform(gaps, lambda x: x.isNotNull()), True)
    return out.when(first > 0, F.concat(F.lit("missing tool_calls["), (first - 1).cast("string"), F.lit("]."), F.get(gaps, (first - 1).cast("int"))))


def card_problem(version: str) -> Column:
    """The first thing wrong with a review card row, null if none."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    out = F.when(F.trim(F.coalesce("schema_version", F.lit(""))) != version, "unsupported schema_version").when(blank("session_id"), "missing session_id").when(~F.coalesce(F.col("verdict").isin("clean", "needs_attention"), F.lit(False)), "unsupported verdict")
    return out.when(blank("main_finding"), "missing main_finding").when(F.col("evidence").isNull(), "missing evidence").when(blank("suggested_next_habit"), "missing suggested_next_habit").when(F.col("warnings").isNull(), "missing warnings")


def finding_problem(types: list[str]) -> Column:
    """The first thing wrong with a finding row (finding_id, type, title, summary), null if none."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank("finding_id"), "missing finding_id").when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), "unsupported type").when(blank("title"), "missing title").when(blank("summary"), "missing summary")


def leaks(texts: DataFrame, markers: DataFrame, text_id: str, text: str, marker_id: str, marker: str, width: int = 24) -> DataFrame:
    """(text_id, marker_id) of texts that contain a whole marker.

    Candidates share the marker's rarest-looking word (its longest inner one),
    so that texts and markers meet by an equi-join of words and ids; the texts
    are fetched for candidates only, and containment is then exact. Markers
    without an inner word (of one or two words, or of white space) are looked
    for in every text, in ``SHORT_BLOCKS`` blocks.
    """
    words = lambda c: F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    inner = F.slice(words(F.col(marker)), 2, F.greatest(F.size(words(F.col(marker))) - 2, F.lit(0)))  # words at the ends may be cut by the text around
    longest = F.aggregate(inner, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    marks = markers.select(F.col(marker_id).alias("m_id"), F.col(marker).alias("m_text"), longest.alias("m_word")).filter("m_text <> ''")
    base = texts.select(F.col(text_id).alias("t_id"), F.col(text).alias("t_text"))
    seen = base.select("t_id", F.explode(F.array_distinct(words(F.col("t_text")))).alias("t_word"))
    pairs = seen.join(marks.filter("m_word <> ''").select("m_id", "m_word").distinct(), F.col("t_word") == F.col("m_word")).select(F.col("t_id").alias("c_t"), F.col("m_id").alias("c_m")).distinct()
    long = marks.filter("m_word <> ''").select("m_id", "m_text")
    held = pairs.join(long, F.col("c_m").eqNullSafe(F.col("m_id"))).join(base, F.col("c_t").eqNullSafe(F.col("t_id"))).filter(F.col("t_text").contains(F.col("m_text")))
    short = marks.filter("m_word = ''").groupBy(F.pmod(F.xxhash64("m_text"), F.lit(SHORT_BLOCKS)).alias("m_block")).agg(F.collect_list(F.struct("m_id", "m_text")).alias("m"))
    scanned = base.crossJoin(short).select("t_id", F.explode(F.filter("m", lambda x: F.col("t_text").contains(x["m_text"]))).alias("m")).select("t_id", "m.m_id")
    return held.select("t_id", "m_id").unionAll(scanned).select(F.col("t_id").alias(text_id), F.col("m_id").alias(marker_id)).distinct()


def may_flow(source: str, target: str) -> bool:
    """Whether data of one class may become the other's without review: never from closed to more open unchecked, so ranks must not fall."""
    return LATTICE[target] >= LATTICE[source]


def scorecard(checks: DataFrame) -> DataFrame:
    """``checks`` (dimension, blocking, failures) with ``state``: green without failures, else red if blocking, amber if not."""
    state = F.when(F.col("failures") == 0, "green").when(F.col("blocking"), "red").otherwise("amber")
    return checks.withColumn("state", state)
