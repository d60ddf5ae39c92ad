"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import base64
import hashlib
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chartloom.llm import ann, bpe, compression, dartminhash, langid, line_dedup, packing, quality, sharding, training_order
from chartloom.llm.registered import QUERIES, tokenizer_file
from chartloom.llm.tables import read, ready

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, None, None, None, None, "a"), (2, "", "en", "s", 0, None), (3, "  \n\t\n ", "en", None, 5, "b"), (None, "one two three four five six seven eight nine", "en", "s", None, "c"),
    (4, LONG, "en", "s", len(LONG), "d"), (5, "one two three four five six seven eight nine", "de", "s", 44, "e"), (5, "one two three four five six seven eight nine", "de", "s", 44, "e"),
    (6, "Σίσυφος é \x1c x<|endoftext|>y 'll don't 123 … 日本語", "fr", "s", -1, "f"), (7, "a" * 3000, "en", "s", 3000, "g"),
]


@pytest.fixture(scope="module")
def odd(spark):
    ready(spark)
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents")


def ids_of(data):
    out = array("I")
    out.frombytes(data)
    return list(out)


def test_bpe_matches_the_library():
    library, own = Tokenizer.from_file(tokenizer_file()), bpe.tokenizer(tokenizer_file())
    random = np.random.default_rng(1)
    pool = list("abcXYZ 'stdlmrev\n\t0123!?#é̈́Σσςß中文한́  \x1c") + ["<|endoftext|>", "<|"]
    texts = [t or "" for _, t, *_ in ODD] + ["".join(random.choice(pool, random.integers(0, 60))) for _ in range(1500)]
    for text, data in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(data) == want, text[:60]
        assert own.decode([data])[0] == library.decode(want, skip_special_tokens=False)
    # One encoding whatever stands beside a text, and every code point.
    points = ["a" + chr(c) + "b" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    assert [ids_of(d) for d in own.encode(points)] == [e.ids for e in library.encode_batch(points, add_special_tokens=False)]


def test_bpe_query(spark, docs):
    library = Tokenizer.from_file(tokenizer_file())
    got = {r.doc_id: r for r in QUERIES["op8_rank_array_bpe"](spark, SF).collect()}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_harmonic_bins():
    random = np.random.default_rng(8)
    for lengths in (random.integers(1, 4097, 500), np.full(300, 4096), np.full(301, 2049), np.ones(5000, int), random.integers(1, 60, 3000), np.array([7]), np.array([4096, 1])):
        by_bin, by_place = defaultdict(list), defaultdict(list)
        for place, start, n, bin_, offset in packing.fill_bins(lengths):
            assert n > 0
            by_bin[bin_].append((offset, n))
            by_place[place].append((start, n))
        for pieces, size in ((by_bin, 4096), (by_place, None)):
            for key, of in pieces.items():
                ends = np.cumsum([0, *(n for _, n in sorted(of))])
                assert [s for s, _ in sorted(of)] == ends[:-1].tolist() and (ends[-1] <= size if size else ends[-1] == lengths[key])
        assert len(by_place) == len(lengths) and sorted(by_bin) == list(range(len(by_bin)))
        # All but the last bin are nearly full.
        assert len(by_bin) * 4096 <= lengths.sum() * (1 + 2 * packing.LOSS / 4096) + 2 * 4096
    # Bins of a class hold its fixed count, next to what fills them.
    lengths = np.concatenate([np.full(90, 1300), np.full(200, 50)])
    for k in Counter(b for p, _, _, b, _ in packing.fill_bins(lengths) if p < 90).values():
        assert k == 3


@pytest.mark.parametrize("worker_bytes", [packing.WORKER_BYTES, 60_000])
def test_packing(spark, docs, odd, worker_bytes):
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id is null or doc_id <> 5").selectExpr("doc_id + 1000000 as doc_id", "text"))
    rows = packing.pack(both, tokenizer_file(), worker_bytes=worker_bytes).collect()
    encode = bpe.tokenizer(tokenizer_file()).encode
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 4096
    cut = 0
    for doc in both.collect():
        cut += len(by_doc[doc.doc_id]) > -(-by_doc[doc.doc_id][0].doc_tokens // 4096)
        pieces = sorted(by_doc[doc.doc_id], key=lambda r: r.start)
        want = encode([doc.text])[0] + (2).to_bytes(4, "little")
        assert b"".join(p.ids for p in pieces) == want and {p.doc_tokens for p in pieces} == {len(want) // 4}
        assert [p.start for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces[:-1])]))
    used = 0
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        used += at
    # Little padding: one open bin of each worker and the gaps not worth a cut; most documents stay in one piece.
    workers = max(1, both.agg(F.sum(F.octet_length("text"))).first()[0] // worker_bytes + 1)
    assert len(bins) * 4096 - used <= 4096 * workers + 0.02 * used and cut < 0.25 * len(by_doc)


def test_training_order(spark, docs, tmp_path):
    for n in (1, 2, 7, 1000):
        for key in (0, 5):
            assert sorted(training_order.permuted(np.arange(n), n, key)) == list(range(n))
    assert (training_order.permuted(np.arange(1000), 1000, 1) != training_order.permuted(np.arange(1000), 1000, 2)).any()
    shards = training_order.training_shards(docs, tokenizer_file(), 3, length=256, records=16)
    training_order.write_shards(shards, str(tmp_path / "shards"))
    rows = training_order.read_from(spark, str(tmp_path / "shards"), 0, 16).collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and all(r.shard == r.slot // 16 and r.position == r.slot % 16 for r in rows)
    encode, parts = bpe.tokenizer(tokenizer_file()).encode, defaultdict(dict)
    for r in rows:
        parts[r.doc_id][r.piece] = bytes(r.tokens)
    for d in docs.collect():
        assert b"".join(parts[d.doc_id][k] for k in sorted(parts[d.doc_id])) == encode([d.text])[0] + (2).to_bytes(4, "little")
    resumed = training_order.read_from(spark, str(tmp_path / "shards"), 37, 16).collect()
    assert [r.slot for r in resumed] == list(range(37, len(rows)))
    for r in spark.read.parquet(str(tmp_path / "shards")).collect():
        assert len(r.payload) == r.records * r.stride


def edits(x, y):
    """Whether two word lists are at most one edit apart."""
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    long, short = (x, y) if len(x) > len(y) else (y, x)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_lines(rows):
    lines = [((-1 if i is None else i, n), line, line.split(" ")) for i, t, *_ in rows for n, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    out = {}
    for place, line, words in lines:
        out[place] = any(p < place and (line == other or len(words) >= 8 and len(w) >= 8 and edits(words, w)) for p, other, w in lines)
    return out


def test_line_dedup(spark, odd):
    base = "the quick brown fox jumps over the lazy dog today".split(" ")
    rows = [(1, "\n".join([" ".join(base), "short", ""]), None, None, 0, None), (2, " ".join([*base, "again"]), None, None, 0, None), (3, " ".join(base[1:]), None, None, 0, None)]
    rows += [(4, " ".join([*base[:3], "wolf", *base[4:]]) + "\nshort\n" + "x " * 8 + "y", None, None, 0, None), (5, " ".join([*base[2:], "other", "end"]), None, None, 0, None)]
    rows += [(6, " ".join(["a", *base[2:]]), None, None, 0, None), (7, LONG + " one", None, None, 0, None), (8, LONG + " two", None, None, 0, None), (9, " ".join(base[:7]) + "\n" + " ".join(base[:6]), None, None, 0, None)]
    rows += [(20 + i, " ".join([*base[:i], f"n{i}", *base[i:]]) + f"\nitem {i} of a list with the same words every time", None, None, 0, None) for i in range(9)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_lines(rows)
    for i, text, *_ in rows:
        kept = [line for n, line in enumerate(text.split("\n")) if not want.get((i, n), False)]
        assert got[i].text == "\n".join(kept), i
        assert got[i].n_dropped == len(text.split("\n")) - len(kept)
    strange = line_dedup.dedup_lines(odd).collect()
    assert len(strange) == len(ODD) and {r.extra for r in strange} == {r[5] for r in ODD}
    assert [r.text for r in strange if r.doc_id is None] == [ODD[3][1]] and [r.text for r in strange if r.doc_id == 5] == ["", ""]


def test_dartminhash_is_weighted_jaccard():
    random = np.random.default_rng(2)
    for share in (0.3, 0.8):
        n = 400
        both = random.integers(0, 1 << 62, int(2 * n * share / (1 + share))).astype(np.uint64)
        sets = [np.concatenate([both, random.integers(0, 1 << 62, n - len(both)).astype(np.uint64)]) for _ in range(2)]
        a, b = dartminhash.signatures_of(sets, 2000)
        assert abs((a == b).mean() - dartminhash.weighted_jaccard(*sets)) < 0.05
    assert (dartminhash.signatures_of([np.array([7], np.uint64), sets[0]], 64)[0] != 0).all()


def test_near_duplicates(spark, docs, odd):
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    base = list(random.choice(words, 200))
    copies = []
    for k in range(40):
        t = list(base)
        for at in random.integers(0, 200, k % 8):
            t[at] = f"z{k}"
        copies.append((10_000_000 + k, " ".join(t)))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    texts = [t for t in first if t.split()]
    units = dict(zip(texts, dartminhash.units_of(texts, dartminhash._WordHashes())))
    holders, parent = defaultdict(list), {first[t]: first[t] for t in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for t in texts:
        shared = Counter(o for u in units[t].tolist() for o in holders[u])
        for o, n in shared.items():
            if n / (len(units[t]) + len(units[o]) - n) >= 0.8:
                a, b = root(first[t]), root(first[o])
                parent[max(a, b)] = min(a, b)
        for u in units[t].tolist():
            holders[u].append(t)
    want = {i: root(first[t]) if t.split() else i for i, t in rows}
    got = {r.doc_id: r for r in dartminhash.near_duplicates(table).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == set(want.values())
    strange = dartminhash.near_duplicates(odd).collect()
    assert len(strange) == len(ODD) and sum(r.kept for r in strange) == len(ODD) - 2
    assert dartminhash.keep_one(odd).count() == len(ODD) - 2 and dartminhash.keep_one(odd).columns == odd.columns


def test_near_duplicates_with_null_and_repeated_ids(spark):
    def group(name, n, ids):
        words = [f"{name}{i}" for i in range(200)]
        return [(i, " ".join([*words[:-1], f"last{k}"])) for k, i in zip(range(n), ids)]

    # Two groups without an id, one whose smallest id comes with three texts, one text alone with that id, and one with a null among its ids.
    rows = group("a", 3, [None] * 3) + group("b", 2, [None] * 2) + group("c", 4, [7, 7, 7, 9]) + group("d", 1, [7]) + group("e", 3, [None, 12, 11]) + [(None, ""), (None, None)]
    rows += [rows[0], rows[5]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, "-" if r.text is None else r.text[:1]) for r in dartminhash.keep_one(table).collect())
    assert kept == [(0, ""), (0, "-"), (0, "a"), (0, "b"), (7, "c"), (7, "d"), (11, "e")]
    found = dartminhash.near_duplicates(table).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(kept)
    assert list(found[0].asDict()) == ["doc_id", "class_id", "n_copies", "n_joining_links", "kept", "root"]
    times = Counter(r.root for r in found)
    assert sorted(times.values()) == [1, 2, 2, 3, 4, 5] and times[None] == 2
    assert Counter(r.root for r in found if r.kept) == {root: 2 if root is None else 1 for root in times}


def test_sharding(spark, docs, odd):
    parts = np.random.default_rng(4).integers(1, 1000, (60, 4))
    place = sharding.differenced(parts)
    sums = np.zeros(4)
    for row, to in zip(parts, place):
        assert sorted(to) == [0, 1, 2, 3]
        np.add.at(sums, to, row)
    assert np.ptp(sums) <= 20
    both = docs.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 1000000 as doc_id", "text"))
    rows = sharding.shard_documents(both, worker_groups=32, block_rows=50).collect()
    assert len(rows) == both.count() and {r.law for r in rows} == {"bytes"}
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    where = defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    sizes = Counter()
    for r in sharding.shard_documents(docs).collect():
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8


def test_compression_bands(spark, docs, odd):
    for r in docs.limit(60).collect() + odd.collect():
        words, text = (r.text or "").encode().split(), r.text or ""
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert compression.base_counts(r.text) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    rows = {r.doc_id: r for r in compression.compression_rules(odd).collect()}
    assert len(rows) == len(ODD) - 1 and rows[1].base_failed and not rows[2].kept and not rows[7].kept
    noise = np.random.default_rng(5).integers(33, 0x2FFF, 40_000)
    assert not compression.bands("".join(map(chr, noise)).encode(), __import__("zstandard").ZstdCompressor(level=3).compress)[3]
    limits = compression.fit(docs, read(spark, SF, "labels"), least=50)
    assert limits is not compression.WIDE and compression.fit(odd, read(spark, SF, "labels")) is compression.WIDE
    for bound in (compression.WIDE, limits):
        kept = {r.doc_id for r in compression.compression_rules(docs, bound).where("kept").collect()}
        assert {r.doc_id for r in compression.kept_documents(docs, bound).collect()} == kept


def test_compression_bands_learn_from_every_good_document(spark):
    """Quartiles and tails are those of all documents labelled good, beyond the 4,000 that were once looked at."""
    random, compress = np.random.default_rng(3), __import__("zstandard").ZstdCompressor(level=3).compress
    words = [f"{random.integers(1 << 40):x}" for _ in range(3000)]
    texts = {i: " ".join(random.choice(words, 60)) for i in range(4500)}
    docs = spark.createDataFrame([*texts.items(), (None, "x"), (5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in [*texts, 5000]], "doc_id long, quality int")
    limits = compression.fit(docs, labels, least=4500)
    assert limits is not compression.WIDE and compression.fit(docs, labels, least=4501) is compression.WIDE
    sizes = {i: len(t.encode()) for i, t in texts.items()}
    step = Counter(round(2 * float(np.log2(n))) for n in sizes.values()).most_common(1)[0][0]
    mine = [i for i, n in sizes.items() if round(2 * float(np.log2(n))) == step]
    low, middle, high = np.quantile([len(compress(texts[i].encode())) / sizes[i] for i in mine], [0.25, 0.5, 0.75])
    at = np.mean([np.log2(sizes[i]) for i in mine])
    assert any(np.allclose(p, (at, middle, max(compression.LEAST_SPREAD, high - low)), atol=2e-5) for p in limits.points)


def test_compression_bands_decide(spark):
    """Fitted on labels of even ids, the bands find most of the poor documents that the base counts let pass, and few good ones."""
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    limits = compression.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = compression.compression_rules(docs, limits).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    poor, good = ([r.kept for r in rows if r.quality == y] for y in (0, 1))
    assert len(poor) > 100 and np.mean(poor) < 0.4 and np.mean(good) > 0.985
    # Verdicts against a plain computation.
    compress = __import__("zstandard").ZstdCompressor(level=3).compress
    texts = {r.doc_id: r.text.encode() for r in docs.where(F.col("doc_id").isin([r.doc_id for r in rows[:300]])).collect()}
    for r in rows[:300]:
        data = texts[r.doc_id]
        low, high = limits.whole(len(data))
        good = low <= len(compress(data)) / len(data) <= high
        for size, least, most in limits.chunks:
            n = -(-len(data) // size)
            starts = [min(i * size, len(data) - size) for i in range(n)] if len(data) >= size else []
            out = sum(not least <= len(compress(data[s : s + size])) / size <= most for s in starts)
            good &= not starts or out / len(starts) <= compression.CHUNK_SHARE
        assert r.kept == good


def test_compression_bands_judge_every_byte():
    compress = __import__("zstandard").ZstdCompressor(level=3).compress
    random, verdict = np.random.default_rng(7), lambda data: compression.bands(data, compress)[3]
    good = [r.text.encode() for r in _labelled_good()]
    noise = lambda n: base64.b64encode(random.bytes(n))[:n]
    phrase = lambda n: (b"this phrase comes back again and again, " * n)[:n]
    for clean, tail in ((2000, noise(1936)), (2000, phrase(1300)), (4150, noise(3900)), (4150, phrase(3000)), (300, noise(180)), (300, phrase(300))):
        texts = [t[:clean] for t in good if len(t) >= clean][:10]
        assert len(texts) == 10 and all(map(verdict, texts)) and not any(verdict(t + tail) for t in texts), (clean, len(tail))


def _labelled_good():
    docs, labels = (pq.read_table(f"/root/testdata/sf0.01/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    rows = docs.merge(labels[labels["quality"] == 1], on="doc_id").sort_values("doc_id")
    counts = [compression.base_counts(t) for t in rows["text"]]
    return rows[[c[0] >= 50 and 100 * c[4] <= 50 * c[0] for c in counts]].itertuples()


def test_language(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_language_codes_and_odd_rows(spark, odd):
    for n in (2, 5, 30):
        code = langid.codewords(n).astype(int)
        assert len({tuple(r) for r in code}) == n and (np.abs(code.sum(0)) < n).all()
    got = {r.doc_id: r for r in langid.identify(odd, langid.fit(odd)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and not got[None].held_out
    nothing = langid.fit(odd.where("doc_id < 0"))
    assert nothing.predict("some text") == ("und", 0.0, False)
    assert langid.Model(["x"], np.ones((1, langid.BUCKETS))).predict("some text")[0] == "x"


def test_quality(spark, odd):
    docs, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    # Learned from four fifths of the labels, held against the rest.
    held = F.col("doc_id") % 5 == 0
    rows = quality.score(docs, quality.fit(docs, labels.where(~held))).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95
    none = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, none)
    assert quality.score(odd, model).where("kept and score = 0.5").count() == len(ODD)
    assert quality.kept_documents(odd, model).columns == odd.columns and quality.kept_documents(odd.select("extra", "text", "doc_id"), model).count() == len(ODD)


def test_samples_hold_one_row_of_a_repeated_id(spark):
    ready(spark)
    rows = [(i, f"{'good words in a row' if i % 2 else '$$ ## 12'} {i}", "en" if i % 3 else "de", "s", 20, "x") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    again = [(7, f"$$ ## 12 {k}", "en", "s", 20, "x") for k in range(100)]
    once, often = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (rows, rows + again))
    plain = quality.fit(once, labels)
    # The row of 7 whose columns hash lowest is the only one that counts, whatever order the rows come in.
    first, second = quality.fit(often, labels), quality.fit(often.orderBy("text"), labels)
    assert np.array_equal(first.both, second.both)
    sizes, model = [], quality.Model

    class Seen(model):
        def __init__(self, text, meta, y, good_share, rounds=quality.ROUNDS):
            sizes.append(len(y))
            super().__init__(text, meta, y, good_share, rounds)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "Model", Seen)
        quality.fit(often, labels)
        quality.fit(often.select("doc_id", "text"), labels)
    assert sizes == [200, 200] and plain.both is not None
    held_out = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200))
    assert zlib.crc32(b"7") % 5 and langid.sample(often).count() == langid.sample(once).count() == 200 - held_out


def test_neighbours(spark):
    random = np.random.default_rng(6)
    points = random.normal(size=(3000, 16)).astype("f4")
    points[50:70] = points[0]
    table = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [None] * 16), (0, [float(x) for x in points[0]]), (9200, [1.0, 2.0])]
    ready(spark)
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    rows = ann.nearest(vectors, F.col("vec_id") % 50 == 0, shard_rows=1000).collect()
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    got, hits = defaultdict(dict), 0
    for r in rows:
        got[r.query_id][r.rank] = (r.vec_id, r.score)
        assert r.score == pytest.approx(float(unit[r.query_id] @ unit[r.vec_id]), abs=1e-9)
    assert set(got) == set(range(0, 3000, 50))
    for q in got:
        sims = [(-round(float(s), 9), i) for i, s in enumerate(unit @ unit[q]) if i != q]
        hits += len({i for _, i in sorted(sims)[:5]} & {i for i, _ in got[q].values()})
    assert hits >= 0.9 * 5 * len(got)
    assert [got[0][k][0] for k in range(1, 6)] == [50, 51, 52, 53, 54]
    few = ann.nearest(spark.createDataFrame(table[:3], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_pipeline_and_empty_tables(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "minhash_near_dedup", "packing"]
    out = corpus_pipeline.run(spark, SF).collect()
    by_doc = defaultdict(int)
    for r in out:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in out) and 0 < len(by_doc) <= docs.count()
    none = docs.limit(0)
    model = quality.fit(none, read(spark, SF, "labels"))
    for df in (
        packing.pack(none, tokenizer_file()), quality.score(none, model), training_order.training_shards(none, tokenizer_file(), 1), line_dedup.dedup_lines(none),
        dartminhash.near_duplicates(none), sharding.shard_documents(none), bpe.encode_documents(none, tokenizer_file()), langid.identify(none, langid.fit(none)),
        compression.compression_rules(none), ann.nearest(read(spark, SF, "embeddings").limit(0), F.lit(True)),
    ):
        assert df.count() == 0


def test_short_and_blank_texts(spark):
    """Slices of fewer words than a shingle, and what counts as a word."""
    ready(spark)
    words = dartminhash._WordHashes()
    for texts, units in ((["a b"], [1]), (["a b c"], [1]), (["a", None, "b c"], [1, 0, 1]), ([""], [0]), (["a b c d"], [1]), (["a b c d e"], [1]), (["a b c d e f"], [2])):
        assert [len(u) for u in dartminhash.units_of(texts, words)] == units
    for text, n in (("a", 1), ("a b", 2), ("a b c", 3), ("a b c d", 5)):
        table = spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string").repartition(1)
        assert [r.doc_id for r in dartminhash.keep_one(table).collect()] == [0]
    blank = ["\u3000", "\u3000", "\x1c", "\x1c", " \t", "\xa0\u2003", "", None]
    table = spark.createDataFrame(list(enumerate(blank)), "doc_id long, text string")
    assert dartminhash.keep_one(table).count() == len(blank)
    assert all(r.kept and r.n_copies == 1 for r in dartminhash.near_duplicates(table).collect())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    shown = spark.createDataFrame([(c, chr(c)) for c in points if c < 0x3100 or c % 997 == 0], "doc_id long, text string")
    assert all(r.word == bool(chr(r.doc_id).split()) for r in shown.select("doc_id", dartminhash.has_word().alias("word")).collect())


def test_clashing_columns(spark, odd):
    names = ["_id", "_th", "_key", "_r", "_d", "_i", "th", "gone", "text_hash", "nth", "gone_doc", "GONE_TEXT", "id", "root", "worker", "hash", "n", "word", "label"]
    strange = odd.select("*", *(F.concat(F.lit(f"{n}-"), "extra").alias(n) for n in names))
    for f in (dartminhash.keep_one, line_dedup.dedup_lines, compression.kept_documents):
        got = f(strange)
        assert got.columns[: len(strange.columns)] == strange.columns
        assert all(r[n] is None or r[n] == f"{n}-{r.extra}" for r in got.collect() for n in names)
    for f in (lambda d: packing.pack(d, tokenizer_file()), dartminhash.near_duplicates, sharding.shard_documents, compression.compression_rules):
        assert f(strange).count() >= len(ODD)


def test_many_languages(spark):
    """A value of its own for every row breaks nothing and is no language."""
    ready(spark)
    rows = [(i, f"word{i} and more of {'the' if i % 2 else 'der'}", f"junk{i}" if i < 600 else ("en" if i % 2 else "de")) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    assert langid.sample(docs, languages=1).select("lang").distinct().count() == 1
    got = langid.identify(docs, model).where("doc_id >= 600").collect()
    assert np.mean([r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got]) > 0.95


def test_training_order_keeps_id_types(spark):
    ready(spark)
    docs = spark.createDataFrame([("a", "some text"), (None, "other text"), ("b", None)], "doc_id string, text string")
    rows = training_order.records_of(training_order.training_shards(docs, tokenizer_file(), 1)).collect()
    assert sorted(r.doc_id or "" for r in rows) == ["", "a", "b"] and sorted(r.slot for r in rows) == [0, 1, 2]
    got = QUERIES["op4_training_order"](spark, SF).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))


def test_packing_deals_a_hot_id(spark):
    ready(spark)
    random = np.random.default_rng(9)
    rows = [(7 if i % 3 == 0 else i, " ".join(random.choice(["alpha", "beta", "gamma", str(i)], 40))) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file(), worker_bytes=4000).collect()
    assert len({r.sequence_id >> packing.BIN_BITS for r in got if r.doc_id == 7}) > 5


def test_neighbours_of_doubles(spark):
    ready(spark)
    points = np.random.default_rng(10).normal(size=(500, 8)) * 1e3
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    norms = np.sqrt((points * points).sum(1))
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0, shard_rows=100).collect():
        assert abs(r.score - float(points[r.query_id] @ points[r.vec_id] / norms[r.query_id] / norms[r.vec_id])) < 1e-15
