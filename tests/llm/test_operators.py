"""The ten operators against brute force, on the hard cases and on an empty table."""

import base64
import collections
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup(hard, empty):
    from tessera.llm.dedup import exact_dedup, keep_one, sha256_digest
    from tests.llm.conftest import HARD

    groups = collections.defaultdict(list)
    for i, t in HARD:
        groups[(t or "").translate(LOWER)].append(i)
    weak = lambda norm: F.unhex(F.lpad(F.hex(F.length(norm) % 3), 2, "0"))  # noqa: E731  collides: bytes must decide
    for digest in (sha256_digest, weak):
        rows = exact_dedup(hard, digest).collect()
        assert len(rows) == len(HARD)
        for text, ids in groups.items():
            own = [r for r in rows if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
            best = max((i for i in ids if i is not None), default=None)
            assert len(own) == len(ids) and {r["keep_id"] for r in own} == {best} and {r["group_size"] for r in own} == {len(ids)}
            assert [r["doc_id"] for r in own if r["kept"]] == [best]
    left = keep_one(hard)
    assert left.columns == hard.columns and left.count() == len(groups)
    assert exact_dedup(empty).count() == 0 and keep_one(empty).count() == 0


def test_dedup_state_goes_on(spark, tmp_path):
    from tessera.llm import dedup

    schema = "digest binary, doc_id long, _tessera_file string, _tessera_row long"
    log, ck = f"file://{tmp_path}/log", f"file://{tmp_path}/ck"
    for part in ([(b"a", 1, "f", 0), (b"b", 2, "f", 1)], [(b"a", 5, "g", 0)], [(b"a", 3, "h", 0), (b"c", 9, "h", 1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(log)
        dedup.ingest(spark, log, spark.read.parquet(log).schema, ck, bytes_per_trigger=1)
    got = {bytes(r["digest"]): (r["keep_id"], r["keep_file"], r["group_size"]) for r in dedup.read_state(spark, ck).collect()}
    assert got == {b"a": (5, "g", 3), b"b": (2, "f", 1), b"c": (9, "h", 1)}


def _shingles(text, width):
    w = (text or "").encode().lower().split()
    n = min(width, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def _near_cases():
    rng, rows = np.random.default_rng(3), []
    for family in range(6):
        base = [f"w{rng.integers(0, 4000)}" for _ in range(int(rng.integers(8, 150)))]
        for _ in range(12):
            text = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 12)))):
                text[int(rng.integers(0, len(text)))] = f"e{rng.integers(0, 9999)}"
            rows.append(" ".join(text))
        rows += rows[-2:]
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [shared + " " + " ".join(f"u{rng.integers(0, 10**6)}" for _ in range(60)) for _ in range(25)]
    rows += [" ".join(f"c{j}" for j in range(k, k + 60)) for k in range(0, 60, 3)]  # a chain: neighbours are near, ends are not
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_against_all_pairs(spark, width):
    from tessera.llm.minhash import near_dedup

    rows = _near_cases()
    sets = {i: _shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_dedup_hard(hard, empty):
    from tessera.llm.minhash import keep_first, near_dedup
    from tests.llm.conftest import HARD

    rows = near_dedup(hard, 2).collect()
    assert len(rows) == len(HARD)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["component_id"] == 0 and not by[1]["kept"] and by[8]["component_id"] == 7 and by[2]["n_shingles"] == 0 and by[2]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert keep_first(hard, 2).columns == hard.columns
    assert near_dedup(empty).count() == 0


def test_repeated_ids_lose_no_link(spark):
    from tessera.llm.minhash import keep_first, near_dedup

    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(5, x), (5, y), (9, x + " tail"), (10, y + " tail"), (3, z), (3, x + " more"), (20, z + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup(df, 2).collect()} == {(5, 3), (9, 3), (10, 3), (3, 3), (20, 3)}
    left = keep_first(df, 2).collect()
    assert len(left) == 1 and left[0]["doc_id"] == 3


def test_rows_of_derived_frames_are_told_apart(spark, tmp_path):
    from tessera.llm.dedup import exact_dedup, keep_one
    from tessera.llm.minhash import keep_first

    path = f"file://{tmp_path}/d"
    spark.createDataFrame([(1, "one two three four"), (2, "five six seven"), (3, "One two three four")], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    for six in (docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), docs.unionByName(docs)):
        assert exact_dedup(six).where("kept").count() == 2 and keep_one(six).count() == 2 and keep_first(six, 2).count() == 2
        assert keep_one(six).columns == six.columns


def test_clashing_names(spark, tmp_path):
    from tessera.llm.dedup import keep_one
    from tessera.llm.minhash import keep_first
    from tessera.llm.sharding import shard_rows
    from tessera.llm.toxicity import drop_toxic

    rows = [(1, "one two three four", "f", 0, "m"), (2, "five six seven", "f", 0, "m"), (3, "One two three four", "f", 0, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _tessera_file string, _tessera_row long, _metadata string")
    path = f"file://{tmp_path}/clash"
    df.write.parquet(path)
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for c in (["_tessera_file", "_tessera_row", "_metadata"], ["_metadata"], ["_tessera_row"]):
        for frame in (df, spark.read.parquet(path)):
            frame = frame.select("doc_id", "text", *c)
            for left, n in ((keep_one(frame), 2), (keep_first(frame, 2), 2), (drop_toxic(frame, labels), 3), (shard_rows(frame, 2).drop("_shard", "_slot"), 3)):
                assert left.columns == frame.columns and left.count() == n
                assert all(r[x] == rows[0][{"_tessera_file": 2, "_tessera_row": 3, "_metadata": 4}[x]] for r in left.collect() for x in c)


def test_near_copies_of_one_large_family(spark):
    from tessera.llm.minhash import near_dedup

    rng = np.random.default_rng(12)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(900):  # indices of pairs around 0.7 to 0.85
        text = list(base)
        for k in rng.choice(120, int(rng.integers(2, 13)), replace=False):
            text[k] = f"e{rng.integers(0, 60)}"
        rows.append((i, " ".join(text)))
    sets = [_shingles(t, 2) for _, t in rows]
    names = {s: k for k, s in enumerate({x for t in sets for x in t})}
    m = np.zeros((len(sets), len(names)), np.float32)
    for i, t in enumerate(sets):
        m[i, [names[x] for x in t]] = 1
    both = m @ m.T
    linked = 100 * both >= 80 * (m.sum(1)[:, None] + m.sum(1)[None] - both)
    label = np.arange(len(sets))
    for _ in range(200):
        label = np.array([label[row].min() for row in linked])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert [got[i] for i in range(len(sets))] == label.tolist() and len({*got.values()}) > 5


def test_hyperminhash_estimates():
    from tessera.llm import minhash as M

    rng = np.random.default_rng(0)
    for n, j in ((40, 0.8), (2000, 0.8), (2000, 0.3), (20_000, 0.0)):
        both = int(2 * n * j / (1 + j))
        s = M.mix(rng.integers(0, 1 << 62, 2 * n, np.uint64))
        a, b = np.unique(s[:n]), np.unique(np.concatenate([s[:both], s[n : 2 * n - both]]))
        r = [M.sketch(x)[None, :] for x in (a, b)]
        est = M.estimate(*r, np.array([len(a)]), np.array([len(b)]))[0]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(est - true) < 5 * max(0.02, (true * (1 - true) / 256) ** 0.5)


def _texts():
    from tests.llm.conftest import HARD

    return [t or "" for _, t in HARD]


def test_packing(spark, hard, empty):
    from tessera.llm.packing import pack

    tok = _tokenizer()
    want = sorted((np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes() for t in _texts()), key=lambda b: (len(b), b))
    for length in (7, 1024):
        rows = pack(hard, JSON, length).collect()
        sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= length
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            documents[r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        for pieces in sequences.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= length
        assert sorted(sequences) == list(range(len(sequences)))
        total = sum(r["length"] for r in rows)
        assert total == sum(len(w) // 4 for w in want) and total > 0.97 * length * (len(sequences) - 1)
        assert collections.Counter(b"".join(p for _, p in sorted(v)) for k, v in documents.items() if sum(len(w) == 4 * k for w in want) == 1) == collections.Counter(w for w in want if sum(len(x) == len(w) for x in want) == 1)
    assert pack(empty, JSON).count() == 0


def _tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    return tok


def test_cutting_stock_patterns():
    from tessera.llm.packing import Plan, solve_patterns

    demand = np.zeros(65, np.int64)
    demand[[40, 24, 20, 44]] = 50
    found = solve_patterns(demand, 64)
    assert sum(n for n, _ in found) == 100 and all(sum(l * k for l, k in p.items()) == 64 for _, p in found)
    rng = np.random.default_rng(5)
    d = np.bincount(rng.integers(1, 64, 3000), minlength=64)[:64]
    plan, taken = Plan(d, 64, 4), collections.defaultdict(list)
    for l in range(1, 64):
        for k in range(d[l]):
            for s, o, n in plan.place(l, k):
                taken[s].append((o, n))
    assert len(taken) == plan.first_full
    for pieces in taken.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64


def _tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(hard, empty):
    from tessera.llm.bpe import decode_documents, encode_documents

    enc = _tiktoken()
    got = decode_documents(encode_documents(hard, RANKS, public_tokenizers.PATTERN, offsets=True), RANKS).collect()
    assert collections.Counter(np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in _texts()) == collections.Counter(bytes(r["ids"]) for r in got)
    assert collections.Counter(t.encode() for t in _texts()) == collections.Counter(bytes(r["decoded"]) for r in got)
    for r in got:
        text = bytes(r["decoded"]).decode()
        assert len(r["offsets"]) == len(r["ids"]) // 4 and (not text or (r["offsets"][0]["start"], r["offsets"][-1]["end"]) == (0, len(text)))
    assert encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_odd_strings():
    import random

    from tessera.llm.bpe import Encoder, from_json, from_ranks

    rng, enc, tok = random.Random(1), _tiktoken(), _tokenizer()
    pool = [" ", "  ", "\n", "\t", "\r\n", "a", "b", "A", "12", ".", "!!", "é", "中", "'s", "x" * 9, " ", "　", "\x1c", "\x85", "abab", "==", "🙂", "‍", "\0", "th", "<|endoftext|>"]
    many, one = Encoder(from_ranks(RANKS, public_tokenizers.PATTERN), 300), Encoder(from_json(JSON), 300)
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert many.encode([text])[0] == np.array(enc.encode_ordinary(text), "<u4").tobytes()
        assert one.encode([text])[0] == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files(spark, hard, empty):
    from tessera.llm.tokenfile import read_token_files, write_token_files
    from tests.llm.conftest import HARD

    manifest = write_token_files(hard, JSON, file_bytes=400)
    assert manifest.count() > 1
    rows = sorted(read_token_files(manifest).collect(), key=lambda r: r["start"])
    tok, at = _tokenizer(), 0
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for _, t in sorted(HARD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    for r, w in zip(rows, want, strict=True):
        assert r["start"] == at and bytes(r["ids"]) == w
        at += len(w) // 4
    some = read_token_files(manifest, wanted=lambda d: d == 7).collect()
    assert [r["doc_id"] for r in some] == [7]
    assert write_token_files(empty, JSON).count() == 0


def test_frames_are_checked():
    import zstandard

    from tessera.llm.tokenfile import FrameReader, FrameWriter

    out = io.BytesIO()
    w = FrameWriter(out)
    for i, raw in enumerate((b"abcd" * 50, b"", b"wxyz")):
        w.add(None if i == 1 else i, raw)
    w.close()
    r = FrameReader(out)
    assert r.ids == [0, None, 2] and [r[i] for i in (2, 0, 1)] == [b"wxyz", b"abcd" * 50, b""]
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read() == b"abcd" * 50 + b"wxyz"
    bad = bytearray(out.getvalue())
    bad[-20] ^= 1
    with pytest.raises(Exception):
        FrameReader(io.BytesIO(bytes(bad)))[2]
    noticed = 0
    for at in range(len(bad)):  # any byte changed: an error, or the right documents (bits of a frame's head that mean nothing)
        for bit in (1, 16, 128):
            bad = bytearray(out.getvalue())
            bad[at] ^= bit
            try:
                r = FrameReader(io.BytesIO(bytes(bad)))
                got = list(zip(r.ids, [r[i] for i in range(len(r))], strict=True))
            except Exception:
                noticed += 1
            else:
                assert got == [(0, b"abcd" * 50), (None, b""), (2, b"wxyz")]
    assert noticed > 0.9 * 3 * len(bad)
    for short in (0, 5, 9, 20, len(bad) - 1):
        with pytest.raises(Exception):
            FrameReader(io.BytesIO(out.getvalue()[:short]))


def test_sharding(spark, hard, empty):
    from tessera.llm.sharding import communication_matrix, permute, shard_rows

    got = shard_rows(hard, 5).collect()
    from tests.llm.conftest import HARD

    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(HARD)
    sizes = collections.Counter(r["_shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5
    assert all(sorted(r["_slot"] for r in got if r["_shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert shard_rows(empty, 5).count() == 0
    for n in (1, 2, 3, 10, 1000):
        assert sorted(permute(np.arange(n), n, 9)) == list(range(n))
    m = communication_matrix([100, 0, 37, 1], 4, 1)
    assert m.sum(axis=1).tolist() == [100, 0, 37, 1] and m.sum(axis=0).tolist() == [35, 35, 34, 34]
    spread = [communication_matrix([10, 10], 2, s)[0, 0] for s in range(3000)]
    assert abs(np.mean(spread) - 5) < 0.1 and abs(np.var(spread) - 10 * 0.25 * 10 / 19) < 0.15  # the hypergeometric law


def test_large_urns(monkeypatch):
    from tessera.llm import sharding as S

    monkeypatch.setattr(S, "URN", 0)  # every draw goes the way of large urns
    rng = np.random.default_rng(4)
    for good, bad, n in ((30, 50, 20), (30, 50, 70), (5, 400, 60), (3, 2, 4)):
        got, want = ([f(good, bad, n) for _ in range(20_000)] for f in (lambda *x: S.hypergeometric(rng, *x), rng.hypergeometric))
        a, b = (np.bincount(x, minlength=good + 1) / 20_000 for x in (got, want))
        assert np.abs(a - b).max() < 0.02
    monkeypatch.undo()
    good, bad, n = 4 * 10**10, 6 * 10**10, 10**9
    z = [(S.hypergeometric(rng, good, bad, n) - 0.4 * n) / (n * 0.4 * 0.6 * (1 - n / (good + bad))) ** 0.5 for _ in range(2000)]
    assert abs(np.mean(z)) < 0.1 and abs(np.std(z) - 1) < 0.07
    counts = rng.integers(900_000, 1_100_000, 20_000).tolist()
    m = S.communication_matrix(counts, 40, 3)
    assert m.sum(axis=1).tolist() == counts and np.ptp(m.sum(axis=0)) <= 1 and m.min() >= 0


def test_shards_do_not_depend_on_the_scan(spark, tmp_path):
    from tessera.llm.sharding import shard_rows

    path = f"file://{tmp_path}/in"
    spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int") % 50).alias("text")).repartition(3).write.option("parquet.block.size", "4096").parquet(path)
    got = []
    for size in ("134217728", "8192"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got.append({tuple(r) for r in shard_rows(spark.read.parquet(path), 7).select("doc_id", "_shard", "_slot").collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1] and len(got[0]) == 5000
    some = shard_rows(spark.read.parquet(path).where("doc_id % 3 = 0"), 7).collect()
    assert len({r["doc_id"] for r in some}) == 1667 and len({(r["_shard"], r["_slot"]) for r in some}) == 1667


def test_winnowing(spark, hard, empty):
    from tessera.llm import winnow as W
    from tests.llm.conftest import HARD

    got = W.with_fingerprint(hard.select("doc_id", "text"), "text", "fp").collect()
    for r in got:
        assert bool(r["fp"]) == bool((r["text"] or "").split())
    assert len({tuple(r["fp"]) for r in got if r["doc_id"] in (7, 8)}) == 1
    long = spark.createDataFrame([(" ".join(f"t{i * 7 % 501}" for i in range(400)),), ("other start " + " ".join(f"t{i * 7 % 501}" for i in range(150, 250)) + " other end",)], "text string")
    a, b = (r["h"] for r in W.with_fingerprint(long, "text", "fp").select(W.hashes(F.col("fp")).alias("h")).collect())
    assert len({*a} & {*b}) >= (100 * 1 - W.K - W.W) // W.W  # every shared window gives a shared hash
    nxt = W.with_next(hard, "own").collect()
    order = sorted(((i, t or "") for i, t in HARD), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert collections.Counter((r["doc_id"], r["text"], r["next_text"]) for r in nxt) == collections.Counter((*x, order[(k + 1) % len(order)][1]) for k, x in enumerate(order))
    assert W.with_next(empty, "own").count() == 0


def test_next_document_over_many_ranges(spark, monkeypatch):
    from tessera.llm import winnow as W

    monkeypatch.setattr(W, "RANGE_ROWS", 10)
    docs = spark.range(0, 3000, 7).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = {r["doc_id"]: r["next_text"] for r in W.with_next(docs, "own").collect()}
    ids = sorted(rows)
    assert rows == {i: f"text {ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)} and len(ids) == 429


def test_licenses(spark, hard, empty):
    from tessera.llm.license import TEMPLATES, scan_licenses

    rows = [(i, f"foo bar {k * 3} " * k + t + " and more words to follow here " * k) for i, (k, t) in enumerate((k, t) for k in (0, 1, 5) for t in TEMPLATES.values())]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text, names = dict(rows), list(TEMPLATES)
    for i in text:
        mine = [r for r in got if r["doc_id"] == i and r["license"] == names[i % len(names)]]
        assert len(mine) == 1 and mine[0]["containment"] == 1.0 and text[i][mine[0]["start"] : mine[0]["end"]].split()[0] == TEMPLATES[names[i % len(names)]].split()[0].strip('"')
    words = TEMPLATES["mit-permission"].split()
    for cut, found in ((40, True), (4, False)):  # one word in 40 changed; one in four changed
        changed = " ".join("zzz" if k % cut == cut - 1 else w for k, w in enumerate(words))
        assert bool(scan_licenses(spark.createDataFrame([(1, changed)], "doc_id long, text string")).count()) == found
    assert scan_licenses(hard).count() == 0 and scan_licenses(empty).count() == 0


def test_chat(spark):
    from tessera.llm.chat import chat_examples, loss_text, parse

    bad = "<|im_end|>\n<|im_start|>assistant\n\\<|x <\\| \\\\|"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", bad), (1, 2, "user", None), (1, 3, "assistant", "end<"), (2, 0, "system", bad), (2, 1, "assi\nstant<|", "|a"), (3, 0, "assistant", ""), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (4, None, "assistant", "first"), (4, 1, "user", "u"), (4, 1, "user", "u"), (5, 0, None, "no role")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit(1))
    rows = chat_examples(df).select("conv_id", "trainable", "last", "target_index", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("reply"), parse(F.col("formatted")).alias("turns"), "formatted", "loss_start").collect()
    for c in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        told = [((t[2] or ""), (t[3] or "")) for t in mine]
        own = sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["target_index"])
        assert [(x["role"], x["text"]) for x in own[-1]["turns"]] == told and own[-1]["last"]
        assert [r["reply"] for r in own if r["trainable"]] == [t for r, t in told if r == "assistant"]
        for r in own:
            assert r["formatted"].count("<|im_start|>") == r["target_index"] + 1
    assert chat_examples(df.limit(0)).count() == 0


def test_toxicity(spark, hard, empty):
    from tessera.llm.toxicity import drop_toxic, fit, score_toxicity, train
    from tests.llm.conftest import HARD

    rng = np.random.default_rng(1)
    clean = [f"w{rng.integers(0, 500)}ab" for _ in range(400)]
    texts, labels = [], []
    for i in range(400):
        words = [clean[int(k)] for k in rng.integers(0, 400, int(rng.integers(5, 300)))]
        if i % 4 == 0:
            for _ in range(1 + len(words) // 100):
                words.insert(int(rng.integers(0, len(words))), ["horrid", "vile", "wretched"][i % 3])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = train(texts[:300], labels[:300])
    hit = [(model.score(t) >= 0.5) == bool(y) for t, y in zip(texts[300:], labels[300:], strict=True)]
    assert np.mean(hit) > 0.95
    assert model.score("w1ab w2ab horridd w3ab") > model.score("w1ab w2ab w3ab w4ab")  # a misspelling not seen before
    got = score_toxicity(hard, model).collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 for r in got)
    labels_df = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert drop_toxic(hard, labels_df).columns == hard.columns
    assert score_toxicity(empty, fit(empty, labels_df.limit(0))).count() == 0 and train([], []).score("x") == pytest.approx(0.5)


def test_crc_of_query_ids(spark):
    assert spark.sql("SELECT crc32(cast('12' AS binary)) AS c").first()["c"] == zlib.crc32(b"12")
