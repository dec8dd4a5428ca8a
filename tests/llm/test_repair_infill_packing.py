"""Repaired conversations, fill-in-middle and packing against plain brute force, on odd rows and on the given tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from docloom.llm import infill, packing, repair
from docloom.llm.common import table

from tests.llm.fixtures import SCHEMA, odd_documents, write_documents
from tests.oracle import compare, connect

TALK = "conv_id long, turn long, role string, text string, copy int, digest string"


def odd_talk(n=60, seed=4):
    rng = random.Random(seed)
    rows = []
    for conv in [None, 2**53 + 1, *range(1, n)]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = rng.choice(["Hello there.", "No end", "Why?", "", " \t", None, "é!\n", "A. B", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text, 7, "x"))
    return rows + rows[:9]


def long_talk(n=700):
    rng = random.Random(9)
    return [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["One.", "two", f"Three {t}.", ""]), 1, "x") for t in range(n)] + [(6, 1, "user", "Hi.", 1, "x")]


def plain_repair(rows):
    """The contract, read row by row; the best edits by recursion from the end."""
    talks, every = defaultdict(list), set()
    for conv, turn, role, text, *_ in rows:
        every.add(conv)
        shown = lambda x: " " if x is None else str(x)
        role, text, kind = shown(role), shown(text), zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        talks[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = set()
    for conv in every:
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
        mine, seen, faults = sorted(talks[conv], key=key), set(), []
        for _, role, text in mine:
            signs = [c for c in text if c not in " \t\n\x0b\x0c\r"]
            faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "" if signs[-1] in ".!?" else "truncated")
            seen.add((role, text))
        out.add((conv, *counts(mine, faults), *best(mine, faults)))
    return out


def counts(mine, faults):
    turns = [t for t, *_ in mine if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs))


def best(mine, faults):
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def rest(i, q, inserted):
        found = [(0, "", ())] if i == len(mine) and q in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if (q, role[0]) in after:
                    c, a, lines = rest(i, after[q, role[0]], inserted + 1)
                    found.append((c + 2, "I" + a, (role + ":", *lines)))
        if i < len(mine):
            _, role, text = mine[i]
            c, a, lines = rest(i + 1, q, 0)
            found.append((c + 3, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for cost, letter, to in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant")):
                    if (q, to[:1]) in after:
                        c, a, lines = rest(i + 1, after[q, to[:1]], 0)
                        found.append((c + cost + more, letter + a, (f"{to}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = rest(0, "", 0)
    return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_equals_brute_force(spark):
    rows = odd_talk()
    df = spark.createDataFrame(rows, TALK).repartition(3)
    want = plain_repair(rows)
    assert set(map(tuple, repair.repair(df).collect())) == want
    assert set(map(tuple, repair.repair(df, block_rows=2).collect())) == want


def test_one_long_conversation_is_repaired_in_blocks(spark):
    import sys

    rows = long_talk()
    sys.setrecursionlimit(20_000)
    df = spark.createDataFrame(rows, TALK).repartition(3)
    made = repair.blocks(repair.with_duplicates(repair.damage(df)), 50)
    assert made.where("conv_id = 5 and n <= 50").select("part").distinct().count() > 1
    assert set(map(tuple, repair.repair(df, block_rows=50).collect())) == plain_repair(rows)


def test_repair_of_the_given_table(spark, sf):
    df = table(spark, sf, "conversations")
    assert set(map(tuple, repair.query(spark, sf).collect())) == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_repaired_texts(spark):
    rows = long_talk(200) + odd_talk()
    df = spark.createDataFrame(rows, TALK).repartition(3)
    texts = defaultdict(list)
    for r in sorted(repair.repaired(*repair.solve(df, 40)).collect(), key=lambda r: (r["part"], r["seq"])):
        texts[r["conv_id"]] += [] if r["lines"] is None else [r["lines"]]
    for conv, *_, audit, sha in plain_repair(rows):
        assert hashlib.sha256("\n".join(texts[conv]).encode()).hexdigest() == sha, (conv, audit)


def test_nothing_to_repair(spark):
    assert repair.repair(spark.createDataFrame([], TALK)).count() == 0
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.repair(spark.createDataFrame([(conv, 0, "user", "Hi.", 1, "x")], TALK)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", repair.NOTHING)]


def test_the_agenda_pops_lightest_first():
    edges = {0: [((1, 0), (5, "K")), ((2, 0), (1, "R"))], 2: [((1, 0), (3, "D")), ((3, 0), (9, "K"))], 1: [((3, 0), (1, "K"))], 3: []}
    final, came = repair.lightest([((0, 0), (0, ""))], lambda item: edges[item[0]])
    assert final == {(0, 0): (0, ""), (2, 0): (1, "R"), (1, 0): (4, "RD"), (3, 0): (5, "RDK")} and came[3, 0] == (1, 0)
    final, _ = repair.lightest([((0, 0), (0, ""))], lambda item: edges[item[0]], lambda item: item[0] == 1)
    assert (3, 0) not in final


# Fill-in-middle


def plain_infill(doc_id, text):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, len(lines), "plain", None, None, sha(t), sha(t)
    form = "spm" if h4 % 100 < 50 else "psm"
    return doc_id, len(lines), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(t)


EXTRA = [(20, "a\nb\n\n\nc"), (21, "\n"), (22, "\n\n\n"), (23, "no end of line"), (24, "has <P> in it\nx"), (25, "😀\n😀😀\r\né z\n"), (26, "x\n" * 5000 + "tail"), (27, "<\nP>\n<S\n>\n"), (28, "S>\nM><P\n")]


def infill_rows():
    return odd_documents() + [(i, t, "en", "s", 1, 5, "h", 7, "x") for i, t in EXTRA] + [(i, "l1\nl2\nl3\nl4\n", "en", "s", 1, 5, "h", 7, "x") for i in range(100, 160)]


def test_infill_equals_brute_force(spark, tmp_path):
    rows = infill_rows()
    got = Counter(map(tuple, infill.query(spark, write_documents(spark, tmp_path, rows)).collect()))
    assert got == Counter(plain_infill(r[0], r[1]) for r in rows)


def test_infill_sql(spark, sf):
    assert compare(connect(sf), infill.query(spark, sf), infill.ORACLE) is None


def test_outputs_and_other_units(spark):
    df = spark.createDataFrame([(i, f"one two\tthree {i}\nfour  five") for i in range(40)], "doc_id long, text string")
    for unit in ("word", "character"):
        rows = infill.infill(df, seed=3, rate=60, spm=30, unit=unit)
        forms = Counter(r["form"] for r in rows.collect())
        assert len(forms) == 3 and forms["plain"] < 30
        assert rows.select("doc_id", infill.restore(rows["output"], rows["form"]).alias("text")).exceptAll(df).count() == 0
    assert infill.infill(df.where("false")).count() == 0


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("ab", "bc", "<M>"), ("<P>", "x<P>", "<M>"), ("", "<S>", "<M>")])
def test_marks_that_can_be_confused_are_refused(marks):
    with pytest.raises(ValueError):
        infill.check_marks(marks)


def test_the_skip_list_reaches_every_rank():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 17, 400):
        widths = [rng.randrange(1, 30) for _ in range(n)]
        lanes = infill.Lanes(widths)
        for rank in range(n + 1):
            units, points, _ = lanes.reach(rank)
            assert (units, points) == (rank, sum(widths[:rank]))
    lanes = infill.Lanes([3] * 100_000)
    assert len(lanes.lanes) > 4 and max(lanes.reach(r)[2] for r in range(0, 100_001, 997)) < 120


# Packing


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def check_packing(got, docs, size=packing.SIZE):
    t = library()
    by_doc, rooms = defaultdict(list), defaultdict(list)
    want = Counter()
    for doc, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), size)):
            cut = ids[at : at + size]
            want[doc, piece, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r["piece"])
    for held in rooms.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(rooms), sum(r["length"] for r in got)


def test_packing_of_odd_documents(spark, tmp_path):
    extra = [(30, "word " * 9000), (31, "x" * 300 + " ÀÉß... it's 'S 中文123 \x1c a\x1db\x85c <|endoftext|> b<|startoftext|>d"), (32, "same text of some length") , (33, "same text of some length")]
    rows = odd_documents() + [(i, t, "en", "s", 1, 5, "h", 7, "x") for i, t in extra]
    got = packing.query(spark, write_documents(spark, tmp_path, rows)).collect()
    n, tokens = check_packing(got, [r[:2] for r in rows])
    assert n == -(-tokens // packing.SIZE)


def test_packing_of_the_given_table_is_near_the_bound(spark, sf):
    got = packing.query(spark, sf).collect()
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    n, tokens = check_packing(got, docs)
    assert n <= -(-tokens // packing.SIZE) + 1


def test_sequences_hold_the_ids_of_their_pieces(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    packed = packing.pack_documents(docs, size=512, keep_ids=True)
    rows = {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(packed).collect()}
    assert all(len(x) <= 512 for x in rows.values())
    for r in packed.collect():
        assert rows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == list(r["ids"])


def test_packing_of_nothing(spark, tmp_path):
    assert packing.query(spark, write_documents(spark, tmp_path, [])).count() == 0
    assert SCHEMA.startswith("doc_id")


def test_programs_against_exact_packing():
    """Histograms whose best packing is known: perfect thirds, halves with fillers, and pairs that must meet."""
    for counts, best in (({40: 30, 30: 60}, 30), ({60: 20, 25: 20, 15: 20}, 20), ({51: 9, 49: 9}, 9), ({100: 5, 1: 100}, 6), ({70: 4}, 4)):
        groups, bound = packing.solve(counts, 100)
        held = Counter()
        for config, times in groups:
            assert sum(length * k for length, k in config.items()) <= 100
            for length, k in config.items():
                held[length] += k * times
        assert held == Counter(counts) and sum(t for _, t in groups) == best and bound <= best + 1e-6


def test_weights_close_in_on_the_bound():
    rng = random.Random(5)
    counts = Counter(rng.randrange(1, 512) for _ in range(4000))
    program, bound = packing.fractional(dict(counts), 512)
    tokens = sum(length * k for length, k in counts.items())
    assert tokens / 512 * 0.98 <= bound <= sum(t for _, t in packing.solve(dict(counts), 512)[0])
    assert sum(x * sum(length * k for length, k in c) for c, x in program.items()) == pytest.approx(tokens)
