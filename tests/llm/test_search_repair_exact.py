"""Lexical search, conversation repair and exact dedup against plain brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

# -- lexical search -----------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    df = Counter(t for _, c in counts for t in c)
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(i, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture
def items(spark):
    rows = [(1, "SHORT line, dolor"), (2, None), (3, ""), (3, "amet id"), (3, "amet ID two"), (None, "equal; café 漢字"), (5, "nothingholdsthis"), (6, "the de la consectetur is long enough to be counted by every document here")]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS score")


def test_search(some_docs, no_docs, items):
    from sessionloom.llm.lexical_search import search

    docs = [(r.doc_id, r.text) for r in some_docs.select("doc_id", "text").collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    out = search(some_docs, items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(out) == ranked(docs, asked)
    assert rows(search(some_docs, items, k=2)) == ranked(docs, asked, 2)
    assert search(no_docs, items).count() == 0 and search(some_docs, items.filter("1 = 0")).count() == 0


def test_search_in_blocks_and_small_shards(some_docs, items, monkeypatch):
    from sessionloom.llm import lexical_search

    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 40)
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 20)
    docs = [(r.doc_id, r.text) for r in some_docs.select("doc_id", "text").collect()]
    got = lexical_search.search(some_docs, items).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked(docs, [(r.item_id, r.text) for r in items.collect()])


def test_sequential_reads_stop_when_all_is_settled():
    from sessionloom.llm.lexical_search import nra

    rng = np.random.default_rng(3)
    for n, low in ((5, 1), (50, 1), (4000, 1), (4000, 900)):
        lists, total = [], np.zeros(n, np.int64)
        for i in range(6):
            doc = rng.choice(n, max(1, n // (1 + i)), replace=False)
            impact = np.sort(np.maximum(low if low > 1 else 0, (rng.pareto(1.5, len(doc)) * 1000).astype(np.int64)))[::-1]
            total[doc] += impact
            lists.append((impact, doc))
        at, score, read = nra(lists, n, 10, first=4)
        assert (total[at] == score).all()
        by = np.lexsort((np.arange(n), -total))[:10]
        assert set(by[total[by] > 0]) <= set(at) and read <= sum(len(x) for x, _ in lists)
    strong = [(np.concatenate([[10_000 - i for i in range(20)], np.ones(4000)]).astype(np.int64), np.arange(4020))]
    assert nra(strong, 4020, 10)[2] < 200


# -- conversation repair --------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"
LEAD = {"s": {(0, 1)}, "u": {(0, 2), (1, 2), (3, 2)}, "a": {(2, 3)}}


def faults(rows):
    """(initial, blank, duplicate, truncated) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        blank = not body
        again = not blank and (role, text) in seen
        seen.add((role, text))
        out.append((role[:1], blank, again, not blank and not again and body[-1] not in ".!?"))
    return out


def cheapest(kinds):
    """From left to right through the places; insertions before a row and at the end."""

    def filled(best):
        while True:
            more = dict(best)
            for p, (c, a) in best.items():
                for q in [q for i in "ua" for p2, q in LEAD[i] if p2 == p]:
                    more[q] = min(more.get(q, (c + 2, a + "I")), (c + 2, a + "I"))
            if more == best:
                return best
            best = more

    best = filled({0: (0, "")})
    for initial, blank, again, cut in kinds:
        nxt = {}
        for p, (c, a) in best.items():
            moves = [(p, c + 3, a + "D")]
            if not blank and not again:
                moves += [(q, c + cut, a + "K") for p2, q in LEAD.get(initial, ()) if p2 == p]
                moves += [(q, c + cut + 2, a + "R") for i in "ua" for p2, q in LEAD[i] if p2 == p]
            for q, *found in moves:
                nxt[q] = min(nxt.get(q, tuple(found)), tuple(found))
        best = filled(nxt)
    return min(best.get(q, (1 << 60, "")) for q in (0, 3))


def rebuilt(audit, rows):
    n = sum(x != "D" for x in audit)
    at, out, rows = n % 2, [], iter(rows)
    slot = 0
    for x in audit:
        role, text = ("", "") if x == "I" else next(rows)
        if x == "D":
            continue
        slot += 1
        out.append((role if x == "K" else ("user" if (slot - at) % 2 else "assistant"), text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return out


def report(talk, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in talk:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20 if damage else 9
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        convs[conv] += [(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        body = [r[1:] for r in rows]
        kinds = faults(body)
        turns = {r[0] for r in rows} - {None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        cost, audit = cheapest(kinds)
        said = "\n".join(f"{r}:{t}" for r, t in rebuilt(audit, body))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(k[i] for k in kinds) for i in (1, 2, 3)), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def test_cells_against_all_edits():
    from sessionloom.llm.talk_repair import parse, verdict

    good = re.compile("(s?(ua)+)?").fullmatch
    fills = [("", "")] + [("I" * n, "".join(x)) for n in (1, 2) for x in itertools.product("ua", repeat=n)]

    def brute(kinds):
        best = (1 << 60, "")
        edits = [[("D", "", 3)] if x == "D" else [("D", "", 3), ("R", "u", 2 + x.isupper()), ("R", "a", 2 + x.isupper()), *([("K", x.lower(), int(x.isupper()))] if x.lower() in "sua" else [])] for x in kinds]
        for chosen in itertools.product(*edits):
            for gaps in itertools.product(fills, repeat=len(kinds) + 1):
                cost = sum(e[2] for e in chosen) + 2 * sum(len(g[0]) for g in gaps)
                if cost <= best[0] and good(gaps[0][1] + "".join(e[1] + g[1] for e, g in zip(chosen, gaps[1:], strict=True))):
                    best = min(best, (cost, gaps[0][0] + "".join(e[0] + g[0] for e, g in zip(chosen, gaps[1:], strict=True))))
        return best

    rng = random.Random(1)
    for kinds in ["", *"suaoSUAOD", *("".join(rng.choices("suaoSUAOD", k=k)) for k in (2, 2, 2, 2, 2, 2, 3, 3))]:
        assert verdict(parse(kinds)) == brute(kinds), kinds


def test_any_split_gives_the_cell():
    from sessionloom.llm.talk_repair import BLOCK, chart, combine, parse, terminal, verdict

    rng = random.Random(2)
    for n in (2, 5, 15, 16, 17, 33):
        kinds = "".join(rng.choices("suaoSUAOD", weights=[1, 5, 5, 1, 1, 2, 2, 1, 2], k=n))
        whole = chart(kinds)
        assert whole == parse(kinds)
        for k in {1, n // 2, n - 1}:
            assert combine(parse(kinds[:k]), parse(kinds[k:])) == whole
    assert BLOCK < 33
    left = terminal("u")
    long = "".join(rng.choices("suaUAD", k=1500))
    for x in ("u" + long)[1:]:
        left = combine(left, terminal(x))
    assert verdict(left) == verdict(parse("u" + long)) == cheapest([("u", False, False, False)] + [(x.lower(), x == "D", False, x in "UA") for x in long])


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(7)
    text = lambda: rng.choice(["Yes.", "no", "Why?", "  \n", "", "Well! ", "a.b", "So. it ends", None])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "supervisor"])
    rows = [(c, t, role(), text()) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t} ends." if t % 7 else "again.") for t in range(400)]  # a long one
    rows += [(101, None, "user", "x."), (101, None, "user", "x."), (101, None, "assistant", "y."), (101, 5, "user", "x."), (101, 9, None, None)]
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None)]
    rows += [(102, 3, "user", "same"), (102, 3, "user", "same"), (102, 3, "assistant", "z."), (102, 4, "user", "same")]
    rows += [(103, None, None, None), (104, 1, "assistant", "long " * 30_000)]
    rows += [(c, 0, "user", "only.") for c in range(200, 260)]  # some lose their only row
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS cost", "'x' AS audit")


def test_repair(talk):
    from sessionloom.llm.talk_repair import repair_report, repaired_rows

    rows = [tuple(r)[:4] for r in talk.collect()]
    for damage in (True, False):
        got = repair_report(talk, damage)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == report(rows, damage)
    assert any(r[-2] == "" and r[-1] == hashlib.sha256(b"").hexdigest() for r in report(rows))
    whole = defaultdict(list)
    for r in repaired_rows(talk).orderBy("conv_id", "position").collect():
        whole[r.conv_id].append(f"{r.role}:{r.text}")
    told = {r[0]: r[-1] for r in report(rows, False)}
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in whole.items()} == {c: h for c, h in told.items() if h != hashlib.sha256(b"").hexdigest()}
    assert repair_report(talk.filter("1 = 0")).count() == 0


def test_a_conversation_lies_in_several_tasks(talk):
    from sessionloom.llm.talk_repair import _told, repairs

    part = _told(talk).repartitionByRange(4, "conv_id", "turn", "role", "digest").selectExpr("conv_id", "spark_partition_id() AS p").distinct()
    assert part.filter("conv_id = 100").count() > 1
    long = talk.filter("conv_id = 100")
    assert repairs(long).collect()[0].audit == next(r for r in report([tuple(r)[:4] for r in long.collect()], False))[-2]


# -- exact dedup ------------------------------------------------------------------


def classes(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in r.text or "" if c not in SPACE)].append(r)
    out = []
    for same, own in groups.items():
        best = min((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in own)
        keep = None if best[1] else best[2]
        out += [(r.doc_id, keep, len(own), r.doc_id == keep and -len(r.text or "") == best[0], hashlib.sha256(same.encode()).hexdigest()) for r in own]
    return sorted(out, key=str)


@pytest.fixture(params=[32, 0, 1])
def digest_bytes(request):
    return request.param


def test_exact_groups(some_docs, no_docs, digest_bytes):
    from sessionloom.llm.exact_dedup import exact_dedup, exact_groups

    out = exact_groups(some_docs, digest_bytes=digest_bytes)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == classes(some_docs.collect())
    assert exact_groups(no_docs).count() == 0
    if digest_bytes == 32:
        stay = exact_dedup(some_docs)
        assert stay.columns == some_docs.columns and stay.count() >= len({x[4] for x in classes(some_docs.collect())})


def test_copies_over_many_buffers_and_salts(spark, monkeypatch):
    from sessionloom.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "BUFFER_ROWS", 7)
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot copy", "hot  copy ", "HOT copy", "hot\tco py", f"own {i % 150}", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    for width in (32, 0):
        assert sorted((tuple(r) for r in exact_dedup.exact_groups(docs, digest_bytes=width).collect()), key=str) == classes(docs.collect())
