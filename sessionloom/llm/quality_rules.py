"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a ratio of two integers of a text and a fixed ladder of cutoffs
from loose to tight. Documents labelled good are the holdout. Per stratum and
rule, a cutoff is certified if the exact (Clopper-Pearson) upper bound of its
false rejection rate, from the count of good holdouts it rejects, is at most
``alpha``. The error level ``delta`` is divided by the number of strata times
rules (Bonferroni); within a ladder cutoffs are tested from loose to tight in
a fixed order that stops at the first failure, which needs no further
division. So with probability 1 - delta, no stratum loses more than
``len(RULES) * alpha`` of its good documents. Among the certified cutoffs of a
rule, the one with the best balance of rejected junk against rejected good
holdouts is used. A stratum with too few labels certifies nothing and keeps
all that pass the base rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, materialize

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a packed window that hold its place, which is below 2**31 in any array; the rest hold its hash.
PLACE_BITS = 31
#: name: (numerator, denominator, above, ladder in hundredths from loose to tight). A text fails above (or below) the cutoff.
RULES: dict[str, tuple[str, str, bool, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "n_words", True, (200, 150, 100, 75, 50, 30, 20, 13, 8, 5, 3, 2, 1)),
    "upper": ("n_upper", "word_chars", True, (80, 60, 50, 40, 30, 25, 20, 15, 12, 10, 8)),
    "repeats": ("n_repeat_words", "n_words", True, (45, 40, 35, 30, 25, 20, 15, 10, 5)),
    "dup_lines": ("n_dup_lines", "n_lines", True, (80, 65, 50, 40, 30, 20, 10, 5)),
    "long_words": ("word_chars", "n_words", True, (1200, 1000, 900, 800, 750, 700, 650, 600, 550)),
    "short_words": ("word_chars", "n_words", False, (200, 250, 300, 350, 375, 400, 425, 450)),
}
#: What a rejected good holdout weighs against a rejected bad one when a certified cutoff is chosen.
GOOD_WEIGHT = 20
#: Rows of cutoffs up to which they are broadcast; beyond, an ordinary join.
BROADCAST_ROWS = 100_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``FEATURES``; input columns of these names are replaced.

    Windows of three words are sorted as packed longs of hash and place; those
    that share a hash with a neighbour are compared as words, so that the
    count is exact.
    """
    docs = docs.drop(*FEATURES)
    text, w, packed, st = fresh(docs, "qr_text", "qr_words", "qr_packed", "qr_same")
    mask = (1 << PLACE_BITS) - 1
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(w, F.filter(F.split(text, BLANK, -1), lambda x: x != ""))
    places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    at = lambda i: [F.get(w, i + k) for k in range(3)]
    df = df.withColumn(packed, F.sort_array(F.transform(places, lambda i: F.xxhash64(*at(i)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))))
    top = lambda x: F.shiftright(x, PLACE_BITS)
    alike = F.filter(packed, lambda x, j: F.coalesce(top(x) == top(F.get(packed, j - 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(packed, j + 1)), F.lit(False)))
    shown = F.transform(alike, lambda x: F.struct(F.concat_ws(" ", *at(x.bitwiseAND(F.lit(mask)).cast("int"))).alias("k"), x.bitwiseAND(F.lit(mask)).cast("int").alias("i")))
    df = df.withColumn(st, F.when(F.size(alike) > 0, F.array_sort(shown)).otherwise(F.array().cast("array<struct<k:string,i:int>>")))
    twice = F.filter(st, lambda x, j: F.coalesce(x["k"] == F.get(st, j - 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(st, j + 1)["k"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": without(BLANKS).cast("long"),
            "n_symbols": (F.length(text) - without(SYMBOLS)).cast("long"),
            "n_upper": (F.length(text) - without(UPPER)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.size(covered).cast("long"),
        }
    ).drop(text, w, packed, st)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fails(rule: str, cut: Column) -> Column:
    num, den, above, _ = RULES[rule]
    return (100 * F.col(num) > cut * F.col(den)) if above else (100 * F.col(num) < cut * F.col(den))


def most_rejections(n: Column, alpha: float, level: Column) -> Column:
    """Largest count k of rejections among ``n`` whose exact upper bound at ``level`` is at most ``alpha``; -1 if none.

    That bound is at most alpha just if P(Bin(n, alpha) <= k) <= level. Terms
    are carried as logarithms; k is below the mean n * alpha.
    """
    a = F.lit(float(alpha))
    start = F.struct((n * F.log(1 - a)).alias("term"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        cdf = acc["cdf"] + F.exp(acc["term"])
        term = acc["term"] + F.log((n - i) * a / ((i + 1) * (1 - a)))
        return F.struct(F.coalesce(term, F.lit(-1e308)).alias("term"), cdf.alias("cdf"), F.when(cdf <= level, i).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * a).cast("long")), start, step, lambda acc: acc["k"])


def certified_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = 0.005, delta: float = 0.05) -> DataFrame:
    """One row per stratum with labels: ``stratum``, ``n_good`` and for each rule the cutoff in use, null if none is certified.

    ``features`` has doc_id, stratum, print (a hash of the text) and
    ``FEATURES``; ``labels`` doc_id and quality (0 or 1). Copies of a text
    within a stratum are one holdout, as the bound asks for independent ones;
    it is good only if all labels of all its copies are 1. Labels without id or
    quality are ignored. Documents that fail the base rule take no part, as no
    cutoff decides on them.
    """
    quality = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("l_quality"))
    labelled = features.filter(~base_failed()).join(quality, F.col("doc_id") == F.col("l_id"))
    known = labelled.groupBy("stratum", "print").agg(F.min("l_quality").alias("l_quality"), *(F.min(c).alias(c) for c in FEATURES))  # features are the same for equal texts
    counts = [F.count_if(F.col("l_quality") == 1).alias("n_good")]
    for rule, (*_, ladder) in RULES.items():
        for c in ladder:
            counts += [F.count_if((F.col("l_quality") == q) & _fails(rule, F.lit(c))).alias(f"{rule}_{c}_{q}") for q in (0, 1)]
    per = known.groupBy("stratum").agg(*counts)
    strata = per.agg(F.count("*").alias("n_strata"))  # one row
    per = per.crossJoin(F.broadcast(strata)).withColumn("most", most_rejections(F.col("n_good"), alpha, F.lit(delta) / (F.col("n_strata") * len(RULES))))
    chosen = []
    for rule, (*_, ladder) in RULES.items():
        # rejections only grow along a ladder, so those within ``most`` are the ones before the first failure
        rungs = F.array(*(F.struct((F.col(f"{rule}_{c}_0") - GOOD_WEIGHT * F.col(f"{rule}_{c}_1")).alias("gain"), F.lit(-i).alias("loose"), F.lit(c).alias("cut"), F.col(f"{rule}_{c}_1").alias("lost")) for i, c in enumerate(ladder)))
        chosen.append(F.array_max(F.filter(rungs, lambda x: (x["lost"] <= F.col("most")) & (x["gain"] > 0)))["cut"].alias(f"cut_{rule}"))
    return per.select("stratum", "n_good", *chosen)


def _verdict(df: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """``df`` with ``base_failed`` and ``kept``, joined with the cutoffs of its stratum."""
    cuts = cuts.select(F.col("stratum").alias("qr_stratum"), *(F.col(f"cut_{r}").alias(f"qr_cut_{r}") for r in RULES)).filter(reduce(lambda a, b: a | b, (F.col(f"qr_cut_{r}").isNotNull() for r in RULES)))
    if cuts.count() <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    rejected = reduce(lambda a, b: a | b, (F.coalesce(_fails(r, F.col(f"qr_cut_{r}")), F.lit(False)) for r in RULES))
    joined = df.join(cuts, F.col(stratum) == F.col("qr_stratum"), "left")
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected}).drop("qr_stratum", *(f"qr_cut_{r}" for r in RULES))


def _features(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    return with_features(plain).withColumn("print", _print(F.col("text"))).drop("text")


def _print(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = 0.005, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row: ``doc_id``, ``FEATURES``, ``base_failed`` and ``kept``.

    A null, empty or blank text has no words and fails the base rule. A null
    stratum is the stratum of the empty string. Repeated rows each give a row;
    equal texts are one holdout. Other columns of ``docs`` are not used, so their names can't clash. An empty table gives an empty
    result; without labels only the base rule rejects.
    """
    feats = materialize(_features(docs, id_col, text_col, stratum_col))
    cuts = materialize(certified_cutoffs(feats, labels, alpha, delta))
    return _verdict(feats, cuts, "stratum").select("doc_id", *FEATURES, "base_failed", "kept")


def quality_filter(docs: DataFrame, labels: DataFrame, alpha: float = 0.005, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns. Cases are as in ``quality_report``.

    Rows are written once together with their features, which costs less than
    to compute features twice or to shuffle all texts to meet their verdicts.
    """
    names = fresh(docs, *(f"qr_in_{i}" for i in range(len(docs.columns))))
    ident, text, stratum = (names[docs.columns.index(c)] for c in (id_col, text_col, stratum_col))
    judged = with_features(docs.toDF(*names), text).withColumns({"doc_id": F.col(ident), "stratum": F.coalesce(F.col(stratum).cast("string"), F.lit("")), "print": _print(F.col(text))})
    judged = materialize(judged)
    cuts = materialize(certified_cutoffs(judged.select("doc_id", "stratum", "print", *FEATURES), labels, alpha, delta))
    return _verdict(judged, cuts, "stratum").filter("kept").select(*(F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)))
