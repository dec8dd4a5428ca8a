"""Tokens, secrets, fingerprints and mixing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from docloom.llm import bpe, common, mixing, secret_scan, simhash

from tests.llm.fixtures import SCHEMA, odd_documents, write_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write_documents(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_documents(spark, tmp_path_factory.mktemp("empty"), [])


def texts(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_encodes_as_the_library_does(spark, sf, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    for folder in (sf, odd):
        want = Counter()
        for i, t, _ in texts(spark, folder):
            ids = library.encode(t or "", add_special_tokens=False).ids
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            back = library.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.query(spark, folder).collect()) == want


def test_random_strings_encode_exactly():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Bpe(bpe.default_vocabulary())
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\x1c", "\x85", "　", "é", "中", "😀", "²", "Ⅷ", "'s", "'S", "<|endoftext|>", "<|", "_", "—", "́", "\x00", "ſ", "ing", "==", "٣", "z" * 40]
    strings = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    for s, got, ref in zip(strings, own.encode(strings), library.encode_batch(strings, add_special_tokens=False)):
        assert got == b"".join(x.to_bytes(4, "little") for x in ref.ids), s


def base_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans(spark, sf, odd):
    for folder in (sf, odd):
        want = Counter()
        for i, t, _ in texts(spark, folder):
            spans = base_spans(t or "")
            n = Counter(k for _, k, _ in spans)
            line = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
            want[i, n[0], n[1], n[2], hashlib.sha256(line.encode()).hexdigest()] += 1
        got = secret_scan.query(spark, folder).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
        for r in got:
            base = [s for s in r["spans"].split(",") if s and not s.startswith("live")]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_ownership_separates_copied_examples(spark):
    copied = [(i, f"password=copied{7777} x", "en", f"src{i % 5}", 1, 1, "", 1, "") for i in range(40)]
    own = [(100, "password=onlymine99", "en", "src1", 1, 1, "", 1, ""), (101, "key Zx9" + "aB3" * 8 + " end", "en", "src1", 1, 1, "", 1, "")]
    docs = spark.createDataFrame(copied + own, SCHEMA)
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact_live(docs).collect()}
    assert len(out) == 42 and all("copied7777" in out[i] for i in range(40))
    assert out[100] == "[secret]" and out[101] == "key [secret] end"


def test_redaction_keeps_rows_and_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = secret_scan.redact_live(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts_out = [r["text"] for r in out.where("doc_id = 12").collect()]
    assert texts_out == ["é" * 50 + " [secret]"]


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    distinct = list({f for _, f in prints})
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints:
        r = find(f)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return Counter((i, f"{f:016x}", least[find(f)]) for i, f in prints)


def test_fingerprints_and_components(spark, sf, odd, empty):
    for folder in (sf, odd, empty):
        want = brute_components([(i, brute_fingerprint(t)) for i, t, _ in texts(spark, folder)])
        assert Counter(tuple(r) for r in simhash.query(spark, folder).collect()) == want


def test_links_of_crowded_buckets(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = [center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)) for _ in range(300)]
    prints += [rng.getrandbits(64) for _ in range(300)]
    chain = [prints[-1]]
    for b in range(0, 40, 2):
        chain.append(chain[-1] ^ (3 << b))
    rows = list(enumerate(prints + chain))
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in rows], "_id long, fp long")
    got = simhash.classes(df, common.Scratch(spark, "t")).collect()
    assert Counter((r["_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in got) == brute_components(rows)


def test_one_of_each_group_stays(spark, odd, sf):
    for folder in (odd, sf):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        classes = {(r["doc_id"]): r["component_id"] for r in simhash.query(spark, folder).collect()}
        out = simhash.keep_one(docs)
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in out.collect()]
        assert sorted(i for i in ids if i is not None) == sorted({c for i, c in classes.items() if i is not None})


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: Fraction((1, 2, 3)[i % 3]) for i, s in enumerate(names)}
    target, open_, left = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing_meets_targets(spark, sf, odd, empty):
    for folder in (sf, odd, empty):
        sizes, source, rows = defaultdict(int), {}, texts(spark, folder)
        for _, t, s in rows:
            sizes[s] += len(WORD.findall(t or ""))
        target = brute_targets(sizes)
        got = mixing.query(spark, folder).collect()
        assert len(got) == len(rows)
        assert sorted(map(str, got)) == sorted(map(str, mixing.query(spark, folder).collect()))
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
        assert all(r["taken"] <= 3 * r["size"] for r in got)
        by = defaultdict(list)
        for r in got:
            by[r["source_size"], round(r["target"], 4)].append(r)
        for s, t in target.items():
            found = by[sizes[s], round(float(t), 4)]
            assert found
            assert abs(sum(r["taken"] for r in found) - float(t) * sum(r["size"] for r in found) / max(1, sizes[s])) <= max(r["size"] for r in found) * len(found)
        if folder == sf:
            total = {s: sum(r["taken"] for r in got if (r["source_size"], round(r["target"], 4)) == (sizes[s], round(float(t), 4))) for s, t in target.items()}
            assert all(abs(total[s] - float(t)) <= max(300, 0.6 * max(len(WORD.findall(x or "")) for _, x, y in rows if y == s)) for s, t in target.items())


def test_mix_repeats_documents(spark, odd, empty):
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = mixing.mix(docs)
        assert out.columns == docs.columns
        taken = sum(r["taken"] for r in mixing.query(spark, folder).collect())
        assert sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == taken
