"""Whole sessions redacted: every string of a session in a fixed order, with placeholders numbered over the session.

A session's strings that a pass may touch become rows with a sortable place,
and all those within nested values that hold one, keys included; the passes
work on the rows; numbers follow the order in which a reader of the session
would come upon the values; and the strings go back to where they were. Only a
level of nesting at a time is unfolded, so depth costs jobs and no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as R
from ..functions.text import quoted
from ..sources.tables import written
from .normalize import SESSION_VERSION, SOURCE
from .quality import session_problem

#: What redaction says of itself.
SUMMARY_VERSION, REDACTED = "redaction_summary.v1", "redacted"
# Fields in the order in which they are visited, and those that are metadata: a value that no pass touches is a secret as a whole.
BEFORE = ("agent_model", "workspace_id", "repo_id", "transcript_path", "source_transcript_session_id", "cwd")
AFTER = ("started_at", "ended_at", "source_event_id", "git_remote", "git_branch", "git_head_sha")
#: Names of fields that lie deeper in a session document than in a row.
LABELS = {"cwd": "workspace.cwd", "git_remote": "git.remote", "git_branch": "git.branch", "git_head_sha": "git.head_sha"}
_TURNS, _CALLS, _CHANGES, _COMMANDS = (len(BEFORE) + i for i in range(4))
_PROVENANCE = len(BEFORE) + 4 + len(AFTER)
SAFE_KEY = "^[A-Za-z0-9_-]{1,80}$"


def _label(*parts: str | Column) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _place(*parts: int | Column) -> Column:
    return F.array(*(p.cast("int") if isinstance(p, Column) else F.lit(p) for p in parts))


def _key_label(key: Column, number: Column) -> Column:
    """How a field's name shows a key: itself if it is plain and no pass touches it, else its number."""
    same = key
    for name, kind, pattern, group in R.PASSES:
        if name in ("api_key", "high_entropy"):  # others need characters that plain keys lack
            same = R.replace_pass(same, name, kind, pattern, group)
    return F.when(key.rlike(SAFE_KEY) & (same == key), F.concat(F.lit("."), key)).otherwise(F.format_string(".[key_%03d]", number))


def nested_strings(df: DataFrame, keep: list[str], place: str, field: str, json: str) -> DataFrame:
    """(keep..., place, field, value, holder) of every string in JSON texts: keys in their order, each before what it holds.

    ``place`` is an array that sorts as a reader visits; ``holder`` is the
    place of a key's object, null for values. Objects, arrays and what they
    hold become the next level's rows, until none are left.
    """
    level = df.select(*keep, F.col(place).alias("place"), F.col(field).alias("field"), F.col(json).alias("j")).filter("j IS NOT NULL")
    found = []
    while True:
        v = F.try_parse_json("j")
        level = written(level.select("*", F.schema_of_variant(v).alias("kind")))
        if level.isEmpty():
            break
        none = F.lit(None).cast("array<int>")
        found.append(level.filter("kind = 'STRING'").select(*keep, "place", "field", F.try_variant_get(v, "$", "string").alias("value"), none.alias("holder")))
        objects = level.filter("startswith(kind, 'OBJECT')").withColumn("m", F.try_variant_get(v, "$", "map<string,variant>"))
        each = objects.select(*keep, "place", "field", "m", F.posexplode(F.array_sort(F.map_keys("m"))).alias("i", "k")).withColumn("n", F.col("i") + 1)
        found.append(each.select(*keep, F.concat("place", _place(F.col("i"), 0)).alias("place"), F.concat("field", F.format_string(".[key_%03d]", "n")).alias("field"), F.col("k").alias("value"), F.col("place").alias("holder")))
        held = each.select(*keep, F.concat("place", _place(F.col("i"), 1)).alias("place"), F.concat("field", _key_label(F.col("k"), F.col("n"))).alias("field"), F.to_json(F.element_at("m", F.col("k"))).alias("j"))
        arrays = level.filter("startswith(kind, 'ARRAY')").select(*keep, "place", "field", F.posexplode(F.try_variant_get(v, "$", "array<variant>")).alias("i", "x"))
        items = arrays.select(*keep, F.concat("place", _place(F.col("i"))).alias("place"), _label(F.col("field"), "[", F.col("i"), "]").alias("field"), F.to_json("x").alias("j"))
        level = held.unionByName(items).filter("j IS NOT NULL AND j <> 'null'")
    return reduce(DataFrame.unionByName, found) if found else level.select(*keep, "place", "field", F.col("j").alias("value"), F.lit(None).cast("array<int>").alias("holder"))


def session_strings(sessions: DataFrame) -> DataFrame:
    """(session_id, place, field, value, holder, meta, root): the strings of sessions that redaction may change, and all of the nested values that hold one; ``root`` is the field of such a value."""
    one = lambda place, field, value, meta=False: F.when((value != "") if meta else R.may_touch(value), F.struct(place.alias("place"), field.alias("field"), value.alias("value"), F.lit(meta).alias("meta")))
    flat = [F.array(*(one(_place(i), F.lit(LABELS.get(c, c)), F.col(c)) for i, c in enumerate(BEFORE)), *(one(_place(_COMMANDS + 1 + i), F.lit(LABELS.get(c, c)), F.col(c), True) for i, c in enumerate(AFTER)))]
    flat.append(F.transform("turns", lambda x, i: one(_place(_TURNS, i), _label("turns[", i, "].content"), x["content"])))
    flat.append(F.transform("tool_calls", lambda x, i: one(_place(_CALLS, i, 1), _label("tool_calls[", i, "].result"), x["result"])))
    flat.append(F.transform("file_changes", lambda x, i: one(_place(_CHANGES, i), _label("file_changes[", i, "].path"), x["path"])))
    flat.append(F.transform("commands", lambda x, i: one(_place(_COMMANDS, i, 0), _label("commands[", i, "].command"), x["command"])))
    flat.append(F.transform("commands", lambda x, i: one(_place(_COMMANDS, i, 1), _label("commands[", i, "].output"), x["output"])))
    plain = sessions.select("session_id", F.explode(F.array_compact(F.flatten(F.array(*flat)))).alias("s")).select("session_id", "s.*")
    # JSON texts that escape more than they must are looked at in their plain form
    held = lambda j: R.may_touch(F.when(j.contains("\\u") | j.contains("\\/"), F.to_json(F.try_parse_json(j))).otherwise(j))
    value = lambda place, root, j: F.when(held(j), F.struct(place.alias("at"), root.alias("root"), j.alias("j")))
    values = F.concat(F.transform("tool_calls", lambda x, i: value(_place(_CALLS, i, 0), _label("tool_calls[", i, "].input"), x["input"])), F.array(value(_place(_PROVENANCE), F.lit("provenance"), F.col("provenance"))))
    roots = sessions.select("session_id", F.explode(F.array_compact(values)).alias("x")).select("session_id", "x.*").withColumn("label", F.col("root"))
    nested = nested_strings(roots, ["session_id", "root"], "at", "label", "j")
    return plain.select("*", F.lit(None).cast("array<int>").alias("holder"), F.lit(None).cast("string").alias("root")).unionByName(nested.withColumn("meta", F.lit(False)))


def _rebuilt(json: Column, tokens: Column) -> Column:
    """A JSON text with its strings replaced in order, keys sorted anew."""
    canon = R.swap(F.to_json(F.try_parse_json(json)))
    quote = lambda x: F.substring(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    parts = F.arrays_zip(F.split(canon, R.JSON_STRING, -1).alias("g"), F.transform(tokens, quote).alias("t"))
    whole = F.array_join(F.transform(parts, lambda x: F.concat(x["g"], F.coalesce(x["t"], F.lit("")))), "")
    return F.to_json(F.try_parse_json(R.swap(whole, True)))


def _replacements(per: DataFrame) -> DataFrame:
    """(n_id, findings, secrets, paths, new, problem) of sessions' changed strings, ``s``, in the order of their places.

    ``new`` has what becomes of a field, for nested values all strings in order
    as a JSON array; ``problem`` says which key comes to be the same as an
    earlier one of its object.
    """
    of_kind = lambda array, kind: F.filter(array, lambda m: m.startswith(f"[REDACTED_{kind}_"))
    marks = per.withColumn("marks", F.array_distinct(F.flatten(F.transform("s", lambda x: x["marks"]))))
    marks = marks.withColumns({"secret": of_kind("marks", "SECRET"), "path": of_kind("marks", "PATH")})
    names = lambda kind: F.transform(kind.lower(), lambda m, i: F.format_string(f"[REDACTED_{kind}_%03d]", i + 1))
    df = marks.select("n_id", "s", F.size("secret").cast("long").alias("secrets"), F.size("path").cast("long").alias("paths"), F.map_from_arrays(F.concat("secret", "path"), F.concat(names("SECRET"), names("PATH"))).alias("names"))
    told = lambda m: F.element_at("names", m)
    shown = lambda x: F.array_join(F.zip_with(F.split(x["text"], R.MARK, -1), F.regexp_extract_all(x["text"], F.lit(R.MARK), F.lit(0)), lambda g, m: F.concat(g, F.coalesce(told(m), m, F.lit("")))), "")
    row = lambda x: F.struct(x["field"].alias("field"), x["root"].alias("root"), x["holder"].alias("holder"), F.when(F.size(x["marks"]) > 0, shown(x)).otherwise(x["text"]).alias("shown"), F.transform(x["marks"], told).alias("made"))
    df = df.withColumn("s", F.transform("s", row)).drop("names")
    side = lambda x, kind, name: F.when(F.size(of_kind(x["made"], kind)) > 0, F.struct(F.lit(name).alias("type"), x["field"].alias("field"), F.size(of_kind(x["made"], kind)).cast("long").alias("n"), F.array_sort(F.array_distinct(of_kind(x["made"], kind))).alias("p")))
    found = F.flatten(F.transform("s", lambda x: F.array_compact(F.array(side(x, "SECRET", "redaction.secret_detected"), side(x, "PATH", "redaction.path_redacted")))))
    listed = F.transform(found, lambda x, i: F.struct(F.format_string("%s.%04d", x["type"], i + 1).alias("id"), x["type"].alias("type"), x["field"].alias("field"), x["n"].alias("replacement_count"), x["p"].alias("placeholders")))
    changed = F.filter("s", lambda x: F.size(x["made"]) > 0)
    flat = F.transform(F.filter(changed, lambda x: x["root"].isNull()), lambda x: F.struct(x["field"].alias("field"), x["shown"].alias("shown")))
    roots = F.array_distinct(F.transform(F.filter(changed, lambda x: x["root"].isNotNull()), lambda x: x["root"]))
    nested = F.transform(roots, lambda r: F.struct(r.alias("field"), F.to_json(F.transform(F.filter("s", lambda x: x["root"] == r), lambda x: x["shown"])).alias("shown")))
    df = df.withColumn("keys", F.filter("s", lambda x: x["holder"].isNotNull()))
    df = df.withColumn("own", F.transform("keys", lambda x: F.concat(F.concat_ws(",", x["holder"].cast("array<string>")), F.lit(" "), x["shown"])))
    met = F.filter(F.transform("keys", lambda x, i: F.when(F.array_position("own", F.get("own", i)) <= i, x)), lambda x: x.isNotNull())
    first = F.when(F.size("own") > F.size(F.array_distinct("own")), F.get(met, F.lit(0)))
    problem = F.concat(first["field"], F.lit(" redacts to duplicate key "), quoted(first["shown"]))
    return df.select("n_id", listed.alias("findings"), "secrets", "paths", F.map_from_entries(F.concat(flat, nested)).alias("new"), problem.alias("problem"))


def redact_sessions(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(redacted sessions, refused ones with ``problem``).

    ``sessions`` are rows of ``normalize.session_rows``, written before, as they
    are read several times. Redacted ones have the
    same columns, ``data_class`` and ``pipeline_status`` (both ``redacted``)
    and ``redaction``: one finding for each field and kind, secrets before
    paths, numbered over the session in the order of its fields, with how many
    replacements were made and the distinct placeholders. Unsound sessions are
    refused, and those in which two keys of an object come to be the same.
    """
    judged = sessions.withColumn("problem", session_problem(SESSION_VERSION, SOURCE))
    sound = judged.filter("problem IS NULL").drop("problem")
    done = R.redact_few(written(session_strings(sound)), "value", "marked", "events", "meta")
    row = F.struct("place", "field", "root", "holder", F.col("marked").alias("text"), F.col("events.marker").alias("marks"))
    kept = F.when((F.size("events") > 0) | F.col("root").isNotNull(), row)  # nested values are put together anew; a filter would be pushed below the passes and repeat them
    per = done.groupBy(F.col("session_id").alias("n_id")).agg(F.array_sort(F.collect_list(kept)).alias("s"))
    new = written(_replacements(per))  # a row of arrays for each session that changes
    joined = sound.join(new, F.col("session_id") == F.col("n_id"), "left").drop("n_id")
    has = lambda part: F.coalesce(F.exists(F.map_keys("new"), lambda k: k.startswith(part + "[")), F.lit(False))
    each = lambda part, change: F.when(has(part), F.transform(part, change)).otherwise(F.col(part))
    told = lambda label, old: F.coalesce(F.element_at("new", label), old)
    plain = lambda old: F.coalesce(F.to_json(F.try_parse_json(old)), old)
    inner = lambda label, old: F.coalesce(F.when(F.element_at("new", label).isNotNull(), _rebuilt(old, F.from_json(F.element_at("new", label), "array<string>"))), plain(old))
    call = lambda x, i: x.withField("input", inner(_label("tool_calls[", i, "].input"), x["input"])).withField("result", told(_label("tool_calls[", i, "].result"), x["result"]))
    summary = F.struct(F.lit(SUMMARY_VERSION).alias("schema_version"), F.lit(REDACTED).alias("data_class"), F.lit(REDACTED).alias("status"), F.coalesce("findings", F.array().cast(new.schema["findings"].dataType.simpleString())).alias("findings"), F.coalesce("secrets", F.lit(0)).alias("secret_placeholders"), F.coalesce("paths", F.lit(0)).alias("path_placeholders"))
    whole = joined.withColumns({
        **{c: told(F.lit(LABELS.get(c, c)), F.col(c)) for c in (*BEFORE, *AFTER)},
        "turns": each("turns", lambda x, i: x.withField("content", told(_label("turns[", i, "].content"), x["content"]))),
        "tool_calls": F.when(has("tool_calls"), F.transform("tool_calls", call)).otherwise(F.transform("tool_calls", lambda x: x.withField("input", plain(x["input"])))),
        "file_changes": each("file_changes", lambda x, i: x.withField("path", told(_label("file_changes[", i, "].path"), x["path"]))),
        "commands": each("commands", lambda x, i: x.withField("command", told(_label("commands[", i, "].command"), x["command"])).withField("output", told(_label("commands[", i, "].output"), x["output"]))),
        "provenance": inner(F.lit("provenance"), F.col("provenance")),
        "data_class": F.lit(REDACTED), "pipeline_status": F.lit(REDACTED), "redaction": summary,
    }).select(*sound.columns, "data_class", "pipeline_status", "redaction", "problem")
    whole = written(whole)
    refused = judged.filter("problem IS NOT NULL").select("session_id", "problem").unionByName(whole.filter("problem IS NOT NULL").select("session_id", "problem"))
    return whole.filter("problem IS NULL").drop("problem"), refused


def not_redacted(sessions: DataFrame) -> Column:
    """Why a session may not be judged, shown or exported, null if it may: its status and its redaction summary must both say that it is redacted."""
    status = F.trim(F.coalesce("pipeline_status", F.lit("")))
    summary = F.trim(F.coalesce("redaction.status", F.lit("")))
    return F.when(status != REDACTED, F.concat(F.lit("pipeline_status "), quoted(status), F.lit(f', want "{REDACTED}"'))).when(summary != REDACTED, F.lit("missing redaction summary"))
