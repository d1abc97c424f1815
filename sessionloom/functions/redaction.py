"""Secrets and local paths replaced by placeholders, in eleven passes over a string.

Each pass works on the outcome of the one before. Markers carry a hash of the
value first; ``numbered`` turns them into running numbers per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import character_classes, entropy, strip_punctuation, trim_space

#: ASCII word boundary (the regular expressions' own is Unicode's here).
_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_S = r"[\t\n\f\r ]"
_NS = r"[^\t\n\f\r "
# Name, kind, pattern, group of the value (0: the match).
PASSES = (
    ("private_key", "SECRET", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", 0),
    ("credential_url", "SECRET", rf"[A-Za-z][A-Za-z0-9+.-]*://{_NS}\"'<>@:/]+:{_NS}\"'<>@]+@{_NS}\"'<>]+", 0),
    ("jwt", "SECRET", rf"{_B}[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{6,}}{_B}", 0),
    ("api_key", "SECRET", rf"{_B}(?:sk-[A-Za-z0-9][A-Za-z0-9_-]{{20,}}|(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{{20,}}|xox[baprs]-[A-Za-z0-9-]{{20,}}){_B}", 0),
    ("ssh_remote", "SECRET", rf"{_B}git@[A-Za-z0-9._-]+:[A-Za-z0-9._~/%+-]+(?:\.git)?{_B}", 0),
    ("assignment", "SECRET", rf"(?i){_B}((?:[A-Z0-9_]*(?:API[_-]?KEY|ACCESS[_-]?TOKEN|AUTH[_-]?TOKEN|TOKEN|SECRET|PASSWORD|PASSWD|JWT)[A-Z0-9_]*){_S}*(?:[:=]{_S}*)+(?:>{_S}*)?)({_NS}\"',;]+)", 2),
    ("space_value", "SECRET", rf"(?i){_B}((?:API[_-]?KEY|ACCESS[_-]?TOKEN|AUTH[_-]?TOKEN|TOKEN|PASSWORD|PASSWD|JWT){_S}+)({_NS}\"',;]+)", 2),
    ("high_entropy", "SECRET", rf"{_B}[A-Za-z0-9+/=_-]{{32,}}{_B}", 0),
    ("posix_path", "PATH", r"/(?:Users|home|tmp|private|var|opt|Volumes)(?:/[A-Za-z0-9._@%+=:,~-]+)+", 0),
    ("secret_path", "PATH", r"(?:~|\.)/[A-Za-z0-9._@%+=:,\-/]*(?:\.env|credentials?|secrets?|secret|token|key)[A-Za-z0-9._@%+=:,\-/]*", 0),
    ("windows_path", "PATH", rf"[A-Za-z]:\\(?:Users|Temp|tmp|Windows|ProgramData)(?:\\{_NS}\"'<>|;]+)+", 0),
)
PATTERN = {name: pattern for name, _, pattern, _ in PASSES}
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
MARK = r"\[REDACTED_(SECRET|PATH)_[0-9a-f]{16}\]"


def already_redacted(c: Column) -> Column:
    return c.contains("[REDACTED_") | c.contains("REDACTED_SECRET_") | c.contains("REDACTED_PATH_")


def skipped(c: Column) -> Column:
    """Blank, already redacted, a digest of 40 or 64 hexadecimal digits, or a UUID."""
    bare = trim_space(c)
    return (bare == "") | already_redacted(bare) | bare.rlike("^(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$") | bare.rlike(UUID)


def looks_random(c: Column) -> Column:
    slashes = F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    return (F.length(c) >= 32) & (slashes < 2) & ~c.contains("/.") & ~c.contains("./") & (character_classes(c) >= 2) & (entropy(c) >= 3.5)


def marker(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"[REDACTED_{kind}_"), F.substring(F.sha2(value, 256), 1, 16), F.lit("]"))


#: What a text must hold, in lower case, for a pattern to match: any of these.
NEEDED = {
    "private_key": ("-----begin ",),
    "credential_url": ("://",),
    "api_key": ("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox"),
    "ssh_remote": ("git@",),
    "assignment": ("key", "token", "secret", "password", "passwd", "jwt"),
    "space_value": ("key", "token", "password", "passwd", "jwt"),
    "posix_path": ("/users/", "/home/", "/tmp/", "/private/", "/var/", "/opt/", "/volumes/"),
    "secret_path": ("~/", "./"),
    "windows_path": (":\\",),
}
#: What it must match as well, where key words are common or there are none; cheap to look for.
SHAPE = {
    "jwt": r"\.(?<=[A-Za-z0-9_-]{10}\.)[A-Za-z0-9_-]{10}",
    "assignment": rf"(?i)(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|JWT)[A-Z0-9_]*{_S}*[:=]",
    "space_value": rf"(?i)(?:KEY|TOKEN|PASSWORD|PASSWD|JWT){_S}",
    "high_entropy": r"(?:^|[^A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{32}",
}


#: What any pass needs, in a text or in its JSON form (backslashes doubled, white space escaped): where this isn't found, no pass matches.
TOUCHES = (
    r"(?i)key|token|secret|passw|jwt|/(?:users|home|tmp|private|var|opt|volumes)/|sk-|gh[pousr]_|xox|git@|\.env|credential|-----begin |:\\{1,2}(?:users|temp|tmp|windows|programdata)"
    rf"|://{_NS}\"'<>@]+@|{SHAPE['jwt']}|{SHAPE['high_entropy']}"
)


def may_touch(text: Column) -> Column:
    return text.rlike(TOUCHES)


def may_match(text: Column, low: Column, name: str) -> Column:
    """False only if the pass's pattern can't match: the text, ``low`` in lower case, lacks its key words or shape. Markers hold neither, so the text before all passes tells."""
    words = [low.contains(x) for x in NEEDED.get(name, ())]
    tests = [reduce(lambda a, b: a | b, words)] if words else []
    return reduce(lambda a, b: a & b, [*tests, *([text.rlike(SHAPE[name])] if name in SHAPE else [])])


def _parts(text: Column, name: str, kind: str, pattern: str, group: int) -> Column:
    """One pass as an array of (gap, said, marker): the text before each match, what becomes of the match, its marker (null if it stays)."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def outcome(gap: Column, m: Column, v: Column) -> Column:
        bare = v if group else strip_punctuation(v)
        touch = ~skipped(bare) & (looks_random(bare) if name == "high_entropy" else F.lit(True))
        mark = F.when(touch, marker(kind, bare))
        tail = F.substring(v, F.length(bare) + 1, F.length(v))
        head = F.substring(m, F.lit(1), F.length(m) - F.length(v))
        return F.struct(gap.alias("gap"), F.coalesce(F.concat(head, mark, tail), m, F.lit("")).alias("said"), mark.alias("marker"))

    return F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("m"), value.alias("v")), lambda x: outcome(x["g"], x["m"], x["v"]))


def _made(parts: Column, number: Column) -> Column:
    """A pass's replacements in order, as (pass, pos, marker)."""
    return F.filter(F.transform(parts, lambda x, n: F.struct(number.alias("pass"), n.alias("pos"), x["marker"].alias("marker"))), lambda x: x["marker"].isNotNull())


def replace_pass(text: Column, name: str, kind: str, pattern: str, group: int) -> Column:
    """One pass: the texts between matches interleaved with what becomes of each match."""
    return F.when(text.rlike(pattern), F.array_join(F.transform(_parts(text, name, kind, pattern, group), lambda x: F.concat(x["gap"], x["said"])), "")).otherwise(text)


def redact(df: DataFrame, text: str, out: str, events: str | None = None) -> DataFrame:
    """``df`` with column ``out``: ``text`` after all passes, values as hash markers. Nulls and blanks stay.

    With ``events``, that column has every replacement in the order in which it
    is made, as (pass, pos, marker).
    """
    guard, parts, low = "_may", "_parts", "_low"
    df = df.withColumns({out: F.col(text), low: F.lower(text)})
    df = df.withColumn(guard, F.array(*(F.coalesce(may_match(F.col(text), F.col(low), name), F.lit(False)) for name, *_ in PASSES))).drop(low)
    if events:
        df = df.withColumn(events, F.array().cast("array<struct<pass:int,pos:int,marker:string>>"))
    for i, (name, kind, pattern, group) in enumerate(PASSES):
        df = df.withColumn(parts, F.when(F.col(guard)[i] & F.col(out).rlike(pattern), _parts(F.col(out), name, kind, pattern, group)))
        found = F.col(parts).isNotNull()
        after = {out: F.when(found, F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], x["said"])), "")).otherwise(F.col(out))}
        if events:
            after[events] = F.when(found, F.concat(F.col(events), _made(F.col(parts), F.lit(i)))).otherwise(F.col(events))
        df = df.withColumns(after)
    return df.drop(guard, parts)


def hits(text: Column, name: str) -> Column:
    """Matches of a pass's pattern on the text as it stands; the pattern is tried only where its key words are."""
    found = F.regexp_count(text, F.lit(PATTERN[name]))
    if name not in NEEDED:
        return found
    low = F.lower(text)
    return F.when(reduce(lambda a, b: a | b, (low.contains(x) for x in NEEDED[name])), found).otherwise(0)


def placeholders(df: DataFrame, group: str, order: list[str], events: str) -> DataFrame:
    """(group, kind, marker, number): markers numbered per group and kind by where they are first made: field, then pass, then place."""
    found = df.select(group, *order, F.inline_outer(events)).filter("marker IS NOT NULL")  # an inner one would pull all passes into a filter
    first = found.groupBy(group, "marker").agg(F.min(F.struct(*order, "pass", "pos")).alias("at")).withColumn("kind", F.lower(F.regexp_extract("marker", MARK, 1)))
    return first.select(group, "kind", "marker", F.row_number().over(W.partitionBy(group, "kind").orderBy("at")).alias("number"))


def numbered(df: DataFrame, group: str, order: list[str], text: str, events: str, out: str, made: str | None = None) -> DataFrame:
    """``df`` with ``out``: the markers of ``text`` as ``[REDACTED_KIND_nnn]``, numbered per group as ``placeholders`` does.

    Markers that the text brought along, of which there is no event, stay. With
    ``made``, that column has the placeholder of every event in order. ``df`` is
    read twice: write it before.
    """
    table = placeholders(df, group, order, events).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("marker", F.format_string("[REDACTED_%s_%03d]", F.upper("kind"), F.col("number"))))).alias("_numbers"))
    joined = df.join(table.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")), "left")
    parts = F.arrays_zip(F.split(text, MARK, -1).alias("g"), F.regexp_extract_all(F.col(text), F.lit(MARK), F.lit(0)).alias("m"))
    whole = F.array_join(F.transform(parts, lambda x: F.concat(x["g"], F.coalesce(F.element_at("_numbers", x["m"]), x["m"], F.lit("")))), "")
    shown = {out: F.when(F.col("_numbers").isNull() | (F.size(events) == 0), F.col(text)).otherwise(whole)}
    if made:
        shown[made] = F.transform(events, lambda x: F.element_at("_numbers", x["marker"]))
    return joined.withColumns(shown).drop("_group", "_numbers")


#: A string of a JSON text, keys included, once escaped backslashes and quotes are stood in for by characters that JSON texts don't hold.
JSON_STRING = '"[^"]*"'
_STAND_INS = (("\\\\", "\x01"), ('\\"', "\x02"))


def swap(c: Column, back: bool = False) -> Column:
    """JSON text with its escaped backslashes and quotes stood in for, or back."""
    for plain, other in reversed(_STAND_INS) if back else _STAND_INS:
        c = F.replace(c, F.lit(other if back else plain), F.lit(plain if back else other))
    return c


def redact_json(df: DataFrame, key: list[str], json: str, out: str) -> DataFrame:
    """``df`` with ``out``: the JSON text of ``json`` with every string in it redacted, at any depth, keys included; other values stay.

    ``key`` tells rows apart. Strings are rows of their own while passes work
    on them, and go back to their places; as markers name their values,
    different keys stay different. Nulls stay null.
    """
    held = df.select(*key, swap(F.col(json)).alias("_json"))
    each = held.select(*key, F.posexplode(F.regexp_extract_all("_json", F.lit(JSON_STRING), F.lit(0))).alias("_pos", "_token")).withColumn("_token", swap(F.col("_token"), True))
    plain = each.withColumn("_plain", F.from_json(F.concat(F.lit("["), "_token", F.lit("]")), "array<string>")[0])
    done = redact(plain, "_plain", "_done")
    quoted = F.expr("substring(to_json(array(_done)), 2, length(to_json(array(_done))) - 2)")
    token = F.when(F.col("_done").eqNullSafe(F.col("_plain")), F.col("_token")).otherwise(quoted)
    tokens = done.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", token.alias("t")))).alias("_tokens"))
    tokens = tokens.select(*(F.col(k).alias(f"_k_{k}") for k in key), F.transform("_tokens", lambda x: x["t"]).alias("_tokens"))
    joined = df.join(tokens, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left")
    parts = F.arrays_zip(F.split(swap(F.col(json)), JSON_STRING, -1).alias("g"), F.coalesce("_tokens", F.array().cast("array<string>")).alias("m"))
    whole = F.array_join(F.transform(parts, lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.coalesce(x["m"], F.lit("")))), "")
    return joined.withColumn(out, F.when(F.col(json).isNotNull(), whole)).drop("_tokens", *(f"_k_{k}" for k in key))


def mark_metadata(df: DataFrame, text: str, out: str, events: str | None = None, where: str | None = None) -> DataFrame:
    """``redact``'s outcome where a non-blank value that no pass touched is a secret as a whole, in the rows that ``where`` flags if it is given."""
    whole = (F.col(where) if where else F.lit(True)) & (F.col(out) == F.col(text)) & (trim_space(F.col(text)) != "") & ~already_redacted(F.col(text))
    mark = marker("SECRET", F.col(text))
    after = {out: F.when(whole, mark).otherwise(F.col(out))}
    if events:  # after all passes
        after[events] = F.when(whole, F.array(F.struct(F.lit(len(PASSES)).alias("pass"), F.lit(0).alias("pos"), mark.alias("marker")))).otherwise(F.col(events))
    return df.withColumns(after)


def redact_metadata(df: DataFrame, text: str, out: str, events: str | None = None, where: str | None = None) -> DataFrame:
    """``redact``, then ``mark_metadata`` (times, revisions, branches of a session)."""
    return mark_metadata(redact(df, text, out, events), text, out, events, where)


def redact_few(df: DataFrame, text: str, out: str, events: str, where: str) -> DataFrame:
    """``redact_metadata``, with passes over those texts only that one may touch. ``df`` is read twice: write it before."""
    touched = may_touch(F.col(text))
    left = df.filter(~touched).withColumns({out: F.col(text), events: F.array().cast("array<struct<pass:int,pos:int,marker:string>>")})
    return mark_metadata(redact(df.filter(touched), text, out, events).unionByName(left), text, out, events, where)


def summary(df: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """(group, kind, field order..., finding, placeholders): one finding per field and kind, secrets before paths, numbered over the group.

    ``placeholders`` are the field's distinct ones, sorted and comma-joined.
    """
    found = df.select(group, *order, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[REDACTED_(?:SECRET|PATH)_[0-9a-f]+\]"), F.lit(0))).alias("placeholder"))
    rank = F.when(F.col("placeholder").startswith("[REDACTED_SECRET"), 0).otherwise(1)
    per = found.withColumn("rank", rank).groupBy(group, *order, "rank").agg(F.array_join(F.array_sort(F.collect_set("placeholder")), ",").alias("placeholders"), F.count("*").alias("replacements"))
    number = F.row_number().over(W.partitionBy(group).orderBy(*order, "rank"))
    return per.select(group, *order, F.when(F.col("rank") == 0, "secret").otherwise("path").alias("kind"), number.alias("finding"), "replacements", "placeholders")
