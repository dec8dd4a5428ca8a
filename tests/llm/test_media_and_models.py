"""Archives, media, models and search against brute force, round trips and held-out accuracy."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from docloom.llm import brown, flac, language, topk, toxicity, warc
from docloom.llm.common import Scratch
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA, odd_documents, write_documents


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write_documents(spark, tmp_path_factory.mktemp("odd2"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_documents(spark, tmp_path_factory.mktemp("empty2"), [])


def documents(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# WARC


def write_pages(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string, archive string, n int").repartition(3).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_archives(spark, sf, tmp_path):
    same = "<html>" + "é copy " * 30
    rows = [(i, "u", same, "a", 1) for i in range(40, 10, -3)] + [(1, "u", None, "a", 1), (2, "u", "", "a", 1), (3, "u", "x" * 99, "a", 1), (4, "u", "x" * 99, "a", 1), (5, "u", "WARC/1.1\r\n\r\n" * 20, "a", 1), (6, "u", "z" * 300, "a", 1), (6, "u", "z" * 300, "a", 1), (None, "u", "z" * 300, "a", 1), (None, "u", "only" * 30, "a", 1)]
    for folder in (write_pages(spark, tmp_path / "odd", rows), write_pages(spark, tmp_path / "none", []), sf):
        pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
        least = {}
        for i, h in pages:
            least[h] = min(least.get(h, math.inf), math.inf if i is None else i)
        got = warc.query(spark, folder).collect()
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len(h), hashlib.sha256(h).hexdigest()) for i, h in pages)
        responses = Counter()
        for r in got:
            first = {hashlib.sha256(h).hexdigest(): v for h, v in least.items()}[r["payload_digest"]]
            if r["payload_bytes"] < 100:
                assert (r["record_type"], r["refers_to"]) == ("response", None)
            elif r["record_type"] == "response":
                responses[r["payload_digest"]] += 1
                assert r["refers_to"] is None and (r["page_id"] if r["page_id"] is not None else math.inf) == first
            else:
                assert r["refers_to"] == first
        assert set(responses.values()) <= {1}


def test_normaliser_makes_members_and_an_index(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>" * 50, "a", 1) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string, n int").coalesce(1)
    listed = Scratch(spark, "t").write(warc.write_archives(pages, f"file://{tmp_path}"), "listed")
    normalised = Scratch(spark, "t").write(warc.normalise(warc.decide(listed)), "normalised")
    crawl, = tmp_path.glob("crawl-*.gz")
    z = zlib.decompressobj(31)
    z.decompress(crawl.read_bytes())
    assert z.eof and not z.unused_data
    normal, = tmp_path.glob("normal-*.gz")
    data = normal.read_bytes()
    index = [json.loads(x) for x in (tmp_path / normal.name.replace(".warc.gz", ".idx.jsonl")).read_text().splitlines()]
    assert len(index) == 20 and [tuple(r)[1:] for r in normalised.collect()] == [(20, len(data))]
    for r in index:
        z = zlib.decompressobj(31)
        body = z.decompress(data[r["offset"] : r["offset"] + r["bytes"]])
        assert z.eof and not z.unused_data and body.startswith(b"WARC/1.1\r\n") and f"<p>{r['n']}</p>".encode() in body
    read = warc.read_archives(normalised).orderBy("page_id").collect()
    assert [(r["page_id"], r["member_offset"], r["member_bytes"]) for r in read] == [(r["n"], r["offset"], r["bytes"]) for r in index]


def test_archives_are_dealt_out_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 5)
    pages = spark.range(60).selectExpr("id as page_id", "repeat('text ', 40) as html").repartition(3)
    listed = Scratch(spark, "t").write(warc.write_archives(pages, f"file://{tmp_path}"), "listed")
    normalised = Scratch(spark, "t").write(warc.normalise(warc.decide(listed)), "normalised")
    assert normalised.count() == 12 and warc.read_archives(normalised).rdd.getNumPartitions() == 12
    got = warc.read_archives(normalised).collect()
    assert sorted(r["page_id"] for r in got) == list(range(60)) and sum(r["record_type"] == "response" for r in got) == 1


# FLAC


def scalar_decode(stream):
    """A plain reader of one frame after the other, bit by bit."""
    _, _, points, first = flac.parse(stream)
    bits = "".join(f"{b:08b}" for b in stream[first:])
    at, out = 0, []

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at] or "0", 2)

    def signed(n):
        x = take(n)
        return x - (1 << n) if n and x >> n - 1 else x

    while at < len(bits):
        begin = at
        assert take(14) == 0x3FFE and take(2) == 0 and take(4) == 7 and take(4) == 0 and take(4) == 0 and take(3) == 1 and take(1) == 0
        lead = take(8)
        for _ in range(0 if lead < 128 else 7 - (lead ^ 255).bit_length()):
            take(8)
        n = take(16) + 1
        take(8)
        assert take(1) == 0
        kind = take(6)
        assert take(1) == 0
        if kind == 0:
            s = [signed(8)] * n
        elif kind == 1:
            s = [signed(8) for _ in range(n)]
        else:
            order = (kind & 31) + 1 if kind >= 32 else kind & 7
            s = [signed(8) for _ in range(order)]
            coef, shift = flac.FIXED[order] if kind < 32 else [], 0
            if kind >= 32:
                width = take(4) + 1
                shift = signed(5)
                coef = [signed(width) for _ in range(order)]
            assert take(2) == 0
            parts = take(4)
            for p in range(1 << parts):
                k = take(4)
                for _ in range((n >> parts) - (order if p == 0 else 0)):
                    q = 0
                    while take(1) == 0:
                        q += 1
                    u = q << k | take(k)
                    r = u >> 1 if not u & 1 else -(u >> 1) - 1
                    s.append(r + (sum(c * s[-1 - i] for i, c in enumerate(coef)) >> shift))
        at += -at % 8
        frame = stream[first + begin // 8 : first + at // 8 + 2]
        c = 0
        for b in frame:
            c = (c << 8 & 0xFFFF) ^ int(flac.CRC16[c >> 8 ^ b])
        assert c == 0
        at += 16
        out += [x + 128 for x in s]
    return bytes(out)


def test_flac_round_trip_and_plain_reader():
    rng = random.Random(2)
    alphabets = [[0], [0, 255], range(256), range(60, 70), [7] * 400 + [255], b"the quick brown fox "]
    payloads = [bytes(rng.choices(list(a), k=192 * n)) for a in alphabets for n in (1, 5, 6, 7, 13)]
    payloads.append(bytes(int(127 + 100 * math.sin(i / 9)) for i in range(192 * 20)))
    payloads.append((b"\x80" * 191 + b"\xff") * 6 * 130)
    streams = flac.encode(payloads)
    assert [b"".join(x for _, x in d) for d in flac.decode(streams)] == payloads
    assert [scalar_decode(s) for s in streams[:31]] == payloads[:31]
    assert [o for o, _ in flac.decode(streams)[-1]] == list(range(0, len(payloads[-1]), flac.BLOCK))


def test_flac_reads_partitions_and_higher_orders():
    x = np.array([int(20 * math.sin(i / 7)) for i in range(192)], np.int64)
    for order in range(5):
        r = x.copy()
        for _ in range(order):
            r = np.concatenate((r[:1], np.diff(r)))
        residual, bits = r[order:], ""
        w = lambda v, n: f"{int(v) & (1 << n) - 1:0{n}b}" if n else ""
        bits += w(8 + order << 1, 8) + "".join(w(v, 8) for v in x[:order]) + w(0, 2) + w(2, 4)
        left = list(residual)
        for p in range(4):
            k = 2 + p
            bits += w(k, 4)
            for _ in range(48 - (order if p == 0 else 0)):
                v = int(left.pop(0))
                u = v << 1 if v >= 0 else (-v << 1) - 1
                bits += "0" * (u >> k) + "1" + w(u, k)
        bits += "0" * (-len(bits) % 8)
        frame = flac.frame_header(0, 192) + int(bits, 2).to_bytes(len(bits) // 8, "big")
        frame += int(flac.crc16([frame])[0]).to_bytes(2, "big")
        got, = flac._decode_frames([frame])
        assert (np.frombuffer(got, np.uint8).astype(int) - 128).tolist() == x.tolist()


def test_flac_checks():
    stream = bytearray(flac.encode([flac.payload("some text " * 100)[0]])[0])
    stream[-60] ^= 8
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_media_of_documents(spark, sf, odd, empty):
    for folder in (sf, odd, empty):
        want = Counter()
        for i, t, _ in documents(spark, folder):
            raw = (t or "").encode()
            p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
        got = flac.query(spark, folder).collect()
        assert Counter(tuple(r)[:5] for r in got) == want
    media = flac.encode_texts(spark.read.parquet(f"{odd}/documents.parquet").selectExpr("doc_id as _id", "text"))
    blocks = flac.pcm_blocks(media).where("_id = 9").orderBy("sample_offset").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks).startswith("Ein <|endoftext|> Wort é".encode())


# Language


def test_language_accuracy_and_edges(spark, sf, odd, empty):
    truth = {i: lang for i, _, lang in documents(spark, sf)}
    got = language.query(spark, sf).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(held) > 20 and sum(held) / len(held) > 0.95
    got = language.query(spark, odd).collect()
    assert len(got) == len(odd_documents())
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (4, 5, 6)) and all(r["lang_pred"] != "und" for r in got if r["doc_id"] == 7)
    assert language.query(spark, empty).count() == 0


def test_bundles_are_sums_of_bound_letters():
    text = "Ab é, c1"
    letters = " ab é c "
    want = np.zeros(language.WIDTH)
    for i in range(len(letters) - 2):
        a, b, c = (language.letter_vector(ord(x)).astype(int) for x in letters[i : i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.array_equal(language.bundle([text, None, "12"], language.Grams()), np.stack([want, 0 * want, 0 * want]))


# Toxicity


def test_lexicon_folds_and_excepts():
    lexicon = toxicity.Lexicon({"trash": 3.0, "idio": 2.0}, ("trash can",))
    total = lambda t: sum(x[2] for x in lexicon.hits(t))
    assert total("You 1D10TS and trаsh") == 5.0  # a Cyrillic letter in the last
    assert total("the trash can, but trash cans are TRASH") == 6.0
    assert total("xtrash no-idiom") == 2.0
    assert 0 <= lexicon.score(None) < lexicon.score("a trash text") <= 1


def test_toxicity_is_learned(spark, tmp_path, odd, empty):
    rng = random.Random(4)
    plain = [f"word{i}x" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        words, bad = rng.choices(plain, k=rng.randint(20, 200)), i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "grobiane", "flegel"]))
        rows.append((i, " ".join(words), "en", "s", 1, 1, "", 1, ""))
        labels.append((i, 1, int(bad)))
    folder = write_documents(spark, tmp_path, rows)
    schema = "doc_id long, quality int, toxic int"
    spark.createDataFrame(labels, schema).write.parquet(f"{folder}/labels.parquet")
    got = toxicity.query(spark, folder).collect()
    assert len(got) == 600 and all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in got)
    held = [(r["predicted"], int(r["doc_id"] % 5 == 0)) for r in got if r["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    for other in (odd, empty):
        spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 0)] if other == odd else [], schema).write.mode("overwrite").parquet(f"{other}/labels.parquet")
        assert toxicity.query(spark, other).count() == (len(odd_documents()) if other == odd else 0)


# Language model


def test_brown_scores(spark, sf, odd, empty):
    for folder in (odd, sf, empty):
        docs = documents(spark, folder)
        words = lambda t: [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        c = Counter()
        for i, t, _ in docs:
            if i is None or crc(i) % 10:
                c.update([*words(t), b""])
        n, v = sum(c.values()), len(c)
        want = defaultdict(list)
        for i, t, _ in docs:
            tokens = [*words(t), b""]
            want[i].append((len(tokens), sum(c[w] > 0 for w in tokens), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
        got = brown.query(spark, folder).collect()
        assert len(got) == len(docs)
        for r in got:
            assert r["train_tokens"] == n and r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 10 == 0)
            assert any(r["n_tokens"] == x and r["n_known"] == y and abs(r["base_score"] - z) < 1e-6 * max(1, -z) for x, y, z in want[r["doc_id"]])
        if folder == sf:
            held = [(r["score"], r["base_score"]) for r in got if r["held_out"]]
            assert sum(a for a, _ in held) > sum(b for _, b in held)


def brown_model(spark, docs, most, monkeypatch, anchors=50, classes=brown.CLASSES):
    monkeypatch.setattr(brown, "ANCHORS", anchors)
    scratch = Scratch(spark, "t")
    vocab = scratch.write(brown.count_words(docs.select("text")), "w")
    top, least = brown.numbered_words(vocab, most)
    numbered = scratch.write(brown.number(docs, top["word"].tolist()).withColumn("row", F.monotonically_increasing_id()), "n")
    model, rare = brown.train(numbered, vocab, top, least, scratch, classes)
    known = {r["h"]: r["class"] for r in rare.collect()}
    number = {w: i for i, w in enumerate(top["word"])}

    def of(w):
        if w == b"" or w in number:
            return int(model["class_of"][number.get(w, len(top))])
        h = int(np.array([xxhash.xxh64_intdigest(w, 42)], np.uint64).view(np.int64)[0])
        return int(known.get(h, model["endings"][brown.ending(w)]))

    return vocab, numbered, model, rare, of, number


def test_brown_model_is_a_distribution_and_joins_rare_words(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as _id", "false as held_out", "cast(text as binary) as text")
    vocab, numbered, model, rare, of, number = brown_model(spark, docs, 300, monkeypatch)
    assert 0 < len(number) <= 300 and np.allclose((10 ** model["log_transition"]).sum(axis=1), 1)
    n = {bytes(r["word"]): r["n"] for r in vocab.collect()}
    mass = defaultdict(float)
    for w, k in n.items():
        mass[of(w)] += (k + 0.1) / 10 ** model["log_class"][of(w)]
    for k, m in mass.items():
        assert abs(m + 0.1 / 10 ** model["log_class"][k] - 1) < 1e-9
    texts = {r["_id"]: bytes(r["text"]) for r in docs.collect()}
    other = spark.createDataFrame([(-1, False, b"never seen befored words anded oftheandin the")], "_id long, held_out boolean, text binary")
    more = numbered.unionByName(brown.number(other, list(number)).withColumn("row", F.lit(-1).cast("long")))
    texts[-1] = b"never seen befored words anded oftheandin the"
    for r in brown.score(more, rare, model).collect():
        tokens = [*brown.words(texts[r["_id"]]), b""]
        before = [b"", *tokens[:-1]]
        want = sum(model["log_transition"][of(a), of(b)] + math.log10(n.get(b, 0) + 0.1) - model["log_class"][of(b)] for a, b in zip(before, tokens))
        assert abs(r["score"] - want) < 1e-6 * max(1, -want) and r["n_known"] == sum(w in n for w in tokens)


def alternating(spark, rare=0):
    """Words of two kinds in turn; with ``rare``, so many words that occur once or twice, each where its kind belongs."""
    rng = random.Random(2)
    texts = [[x for _ in range(20) for x in (f"a{min(rng.randrange(60), rng.randrange(60))}", f"b{min(rng.randrange(60), rng.randrange(60))}")] for _ in range(120)]
    for i in range(rare):
        at = 2 * rng.randrange(18) + i % 2
        texts[i % 120][at] = f"{'xy'[rng.randrange(2)]}{i:04d}zzz"
    return spark.createDataFrame([(i, False, " ".join(t).encode()) for i, t in enumerate(texts)], "_id long, held_out boolean, text binary").repartition(3), texts


def test_words_move_to_the_classes_of_their_contexts(spark):
    """All numbered words are placed as one pass over their neighbours by hand places them, rare ones too."""
    docs, texts = alternating(spark, 60)
    scratch = Scratch(spark, "moves")
    vocab = scratch.write(brown.count_words(docs.select("text")), "w")
    top, least = brown.numbered_words(vocab, 80)
    numbered = scratch.write(brown.number(docs, top["word"].tolist()), "n")
    end, k = len(top), 3
    class_of = np.full(end + 1, -1)
    class_of[:20], class_of[end] = [int(w.startswith(b"b")) for w in top["word"][:20]], 2
    n = np.array([[1.0, 90.0, 1.0], [80.0, 1.0, 9.0], [9.0, 1.0, 0.0]])
    unit = {w: i for i, w in enumerate(top["word"])}
    table = defaultdict(lambda: np.zeros(2 * k))
    for t in texts:
        told = ["", *t, ""]
        c = [2 if w == "" else class_of[unit[w.encode()]] if w.encode() in unit else -1 for w in told]
        for i, w in enumerate(told):
            for near, at in ((i - 1, 0), (i + 1, k)):
                if w and c[near] >= 0:
                    table[w.encode()][at + c[near]] += 1
    for rare in (False, True):
        got = {r["word"]: r["class"] for r in brown.placed(brown.contexts(numbered, class_of, end, 2, rare, 8), n, 2).collect()}
        key = lambda w: int(np.array([xxhash.xxh64_intdigest(w, 42)], np.uint64).view(np.int64)[0]) // brown.NEAR if rare else unit[w]
        mine = {key(w): brown.place(row[None, :], n, 2)[0] for w, row in table.items() if (w not in unit) == rare}
        assert got == mine and got


def test_the_likelihood_rises_and_rare_words_find_their_class(spark, monkeypatch):
    docs, texts = alternating(spark, 100)
    monkeypatch.setattr(brown, "ANCHORS", 20)
    vocab, numbered, model, rare, of, number = brown_model(spark, docs, 125, monkeypatch, 20, 2)
    told = []
    class_of, n = brown.cluster(numbered, len(number), 2, 4, told)
    assert told and all(a < b for a, b in zip(told, told[1:])) and np.array_equal(class_of, model["class_of"])
    sides = [{of(w) for w in number if w.startswith(side)} for side in (b"a", b"b")]
    assert all(len(x) == 1 for x in sides) and sides[0] != sides[1]
    # a rare word stands where its kind does, whatever its letters are
    for t in texts:
        for i, w in enumerate(t):
            if w.endswith("zzz"):
                assert of(w.encode()) == of(b"ab"[i % 2 : i % 2 + 1] + b"0")
    flat = [[of(w.encode()) for w in ["", *t, ""]] for t in texts]
    assert len(flat) == 120 and brown.likelihood(n) == told[-1]


def test_exchange_finds_alternating_classes():
    rng = random.Random(1)
    bigrams = np.zeros((21, 21))
    for _ in range(20000):
        a = rng.randrange(20)
        bigrams[a, (a + 1) % 2 + 2 * rng.randrange(10)] += 1
    of = brown.exchange(bigrams, 2)
    assert len(set(of[:20:2])) == 1 and len(set(of[1:20:2])) == 1 and of[0] != of[1]


# Search


def brute_top(rows, k=20):
    whole = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for i, q in {i: q for i, q in reversed(whole) if i % 20 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in whole if j != i)[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_top_k(spark, sf, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5]) for _ in range(5)], 1, "x") for i in range(400)]
    rows += [(1000 + i, [0.5] * 5, 1, "x") for i in range(300)] + [(2000, None, 1, "x"), (2020, [1.0, None, 1.0, 1.0, 1.0], 1, "x"), (2040, [float("nan")] * 5, 1, "x"), (2060, [float("inf")] * 5, 1, "x"), (None, [1.0] * 5, 1, "x")]
    for name, data in (("odd", rows), ("few", rows[:7]), ("none", [])):
        spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, score string").repartition(3).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "PAGE", 4)
    monkeypatch.setattr(topk, "PACK", 8)
    monkeypatch.setattr(topk, "MEET", 2)
    monkeypatch.setattr(topk, "CHUNK", 3)
    for folder in (sf, f"{tmp_path}/odd", f"{tmp_path}/few", f"{tmp_path}/none"):
        data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        got = topk.query(spark, folder).collect()
        assert {tuple(r) for r in got} == brute_top(data) and len(got) == len({tuple(r) for r in got})


def test_top_k_prunes_where_vectors_are_clustered(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "PAGE", 8)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) / 20).tolist()) for i in range(4000)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    sc = spark.sparkContext
    seen = (sc.accumulator(0), sc.accumulator(0))
    got = topk.search(vectors, vectors.where("vec_id % 20 = 0"), Scratch(spark, "clustered"), seen=seen).collect()
    assert {tuple(r) for r in got} == brute_top(rows)
    assert 0 < seen[0].value < 0.3 * 200 * -(-4000 // 32)
