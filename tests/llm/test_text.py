"""LM scoring, BPE, fingerprints, packing, FLAC, HTML and the classifier."""

import hashlib
import math
import random
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from helpers import shingles, words  # noqa: E402

from tallyspark.llm import bpe, fingerprint, flac, lmscore, packing, quality  # noqa: E402
from tallyspark.llm.htmltext import extract_pages, render  # noqa: E402
from tallyspark.llm.textbytes import word_hashes  # noqa: E402

public = pytest.importorskip("public_tokenizers")


def texts(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(80)]
    out = [" ".join(r.choice(vocabulary[: r.randint(5, 80)]) for _ in range(r.randint(1, 120))) for _ in range(n)]
    return [*out, None, "", " \t\n", "One", out[0], "x" * 5000]


def frame(spark, values):
    return spark.createDataFrame([(i, t, "own") for i, t in enumerate(values)], "doc_id long, text string, piece string").repartition(3)


def test_word_hashes_follow_the_definition():
    values = ["A b\tc\x0bA", "", "é\xa0x Y", "   ", "a"]
    data = [v.encode() for v in values]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    h, doc = word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = [(k, w) for k, v in enumerate(values) for w in words(v)]
    assert doc.tolist() == [k for k, _ in want]
    ids = {}
    assert all(ids.setdefault(w, x) == x for x, (_, w) in zip(h.tolist(), want, strict=True)) and len(set(ids.values())) == len(ids)


# --- LM scoring


def chained(n, seed):
    """Texts in which most words name the next one."""
    r, out = random.Random(seed), []
    for _ in range(n):
        w = [r.randrange(60)]
        for _ in range(r.randint(5, 60)):
            w.append((7 * w[-1] + 3) % 60 if r.random() < 0.7 else r.randrange(60))
        out.append(" ".join(f"W{x}" for x in w))
    return out


def test_lm_scoring(spark):
    values = [*chained(200, 3), *texts()[60:]]
    rows = {r.doc_id: r for r in lmscore.score_documents(frame(spark, values)).collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(values)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    out = [r for i, r in rows.items() if held[i] and i < 200]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)  # both are below 0
    assert lmscore.score_documents(frame(spark, values).limit(0)).count() == 0


def test_lm_score_by_brute_force(spark):
    """The score of every text from counts in dictionaries, with the weights of an EM written out token by token."""
    values = [*chained(120, 8), *texts()[50:], chained(1, 8)[0]]
    docs = frame(spark, values)
    parts = {r.doc_id: 2 if zlib.crc32(str(r.doc_id).encode()) % 7 == 2 else int(r.h % 8 == 0) for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(values)}
    tables = []
    for kinds in ((0,), (0, 1)):  # what the estimates for EM come from, and all training texts
        word = Counter(w for i, t in tokens.items() if parts[i] in kinds for w in t)
        pair = Counter((h, w) for i, t in tokens.items() if parts[i] in kinds for h, w in zip([None, *t], t, strict=False))
        tables.append((word, pair, sum(word.values())))
    word, pair, n = tables[0]
    log2 = lambda x: int(x).bit_length()
    octave = lambda x: math.floor(4 * math.log2(x)) if x > 0 else 1
    cells = defaultdict(lambda: [0, 0.0, 0.0])
    for i, t in tokens.items():
        for h, w in zip([None, *t], t, strict=False) if parts[i] == 1 else []:
            f2, f1 = pair[h, w] / max(word[h], 1), word[w] / n
            cell = cells[log2(word[h]), octave(f2), octave(f1)]
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + f2, cell[2] + f1
    a, low, uniform = defaultdict(lambda: 0.5), 0.9, 1 / (len(word) + 1)
    before = -math.inf
    for _ in range(100):
        high, seen, left, rest, now = Counter(), Counter(), 0.0, 0.0, 0.0
        for (b, _, _), (count, f2, f1) in cells.items():
            f2, f1 = f2 / count, f1 / count
            lower = low * f1 + (1 - low) * uniform
            total = a[b] * f2 + (1 - a[b]) * lower
            share = a[b] * f2 / total
            high[b], seen[b] = high[b] + count * share, seen[b] + count
            left, rest = left + count * (1 - share) * low * f1 / lower, rest + count * (1 - share)
            now += count * math.log(total)
        a.update({b: min(high[b] / seen[b], 1 - 1e-6) for b in seen} | {0: 0.0})
        low = min(max(left / rest, 1e-6), 1 - 1e-6)
        if now - before < 1e-7 * abs(now):
            break
        before = now
    word, pair, n = tables[1]
    for r in lmscore.score_documents(docs).collect():
        t = tokens[r.doc_id]
        want = 0.0
        for h, w in zip([None, *t], t, strict=False):
            weight = a[log2(word[h])]
            want += math.log10(weight * pair[h, w] / max(word[h], 1) + (1 - weight) * (low * word[w] / n + (1 - low) / (len(word) + 1)))
        assert math.isclose(r.score, want, rel_tol=1e-6), r.doc_id


def test_lm_repeated_rows_count(spark):
    """Equal rows are worked on once, and count as often as they are there."""
    rows = [(1, "a b a"), (1, "a b a"), (1, "a b a"), (2, "c"), (None, "a"), (None, None)]
    got = lmscore.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), held_out=F.lit(False)).collect()
    assert len(got) == 6 and {r.train_tokens for r in got} == {12 + 2 + 2 + 1} and len({r.score for r in got if r.doc_id == 1}) == 1
    none = {r.n_known for r in got if r.doc_id is None}
    assert none == {2, 1}


def test_lm_probabilities_sum_to_one_and_em_improves():
    r = np.random.default_rng(0)
    bucket, pair, word, weight = r.integers(0, 5, 500), r.random(500) * 0.5, r.random(500) * 0.1, r.random(500)
    pair[bucket == 0] = 0
    likelihood = lambda a, low: float(np.sum(weight * np.log(a[bucket] * pair + (1 - a[bucket]) * (low * word + (1 - low) * 0.01))))
    seen = [likelihood(*lmscore.learn_weights(bucket, pair, word, weight, 0.01, rounds)) for rounds in (1, 3, 10, 50)]
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:], strict=False))


# --- BPE


@pytest.fixture(scope="module")
def model():
    return bpe.load()


@pytest.fixture(scope="module")
def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path(bpe.TOKENIZER))
    t.no_padding()
    t.no_truncation()
    return t


HARD = ["", " ", "Hello, WORLD's don't I'LL 1234 ½", "ΑΣ ΟΔΥΣΣΕΥΣ İstanbul ẞ ß", "a<|endoftext|>b <|startoftext|> <|end", "日本語テスト한국어 가", "é é ﬁ", "x\u0085y　z\xa0w​", "👩‍👩‍👧 ok", "a" * 3000, "ab" * 5000 + "c"]


def test_bpe_is_the_library(model, library):
    for t in [*HARD, *filter(None, texts())]:
        ids = model.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids and model.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert "".join(model.to_text(model.encode("Héllo wörld"))) == "héllo wörld "


def test_bpe_in_parts(model, library):
    """A text of several parts, and one word of several windows, come out as the library gives them whole."""
    letters = random.Random(4)
    for t in ("x y\n" * 40_000 + "<|endoftext|>é é end", "".join(letters.choice("etaoinshr") for _ in range(100_000)), " " * 200_000 + "a", "no" * 70_000 + " don't"):
        ids, decoder, out = [], bpe.Decoder(model), ""
        for part in bpe.parts(t):
            some = model.encode(part)
            ids += some
            out += decoder.feed(some)
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want and out + decoder.finish() == library.decode(want, skip_special_tokens=False)
    assert "".join(bpe.parts("ab cd\nef", 3)) == "ab cd\nef" and list(bpe.parts("ab cd\nef", 3)) == ["ab ", "cd\n", "ef"]


def test_encode_documents(spark, model):
    values = [*HARD, None, "many words " * 20_000]
    for r in bpe.encode_documents(frame(spark, values)).collect():
        ids = model.encode(values[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest() and r.piece == "own"


@st.composite
def merge_lists(draw):
    """Merge lists as training makes them: each merges two known tokens into a new one."""
    known, merges = ["a", "b", "c"], []
    for _ in range(draw(st.integers(0, 14))):
        x, y = draw(st.sampled_from(known)), draw(st.sampled_from(known))
        if x + y not in known and len(x + y) <= 8:
            known.append(x + y)
            merges.append((x, y))
    return merges


@settings(max_examples=300, deadline=None)
@given(merge_lists(), st.text("abc", max_size=120), st.integers(1, 7))
def test_transducer_emits_what_the_whole_string_gives(merges, text, step):
    ranks = {m: r for r, m in enumerate(merges)}
    machine = bpe.Transducer(ranks, bpe.sufficient_lookahead(merges), window=1)
    out = []
    for k in range(0, len(text), step):
        out += machine.feed(text[k : k + step])
        assert len(machine.held) <= machine.window
    assert out + machine.finish() == bpe.apply_merges(list(text), ranks)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 5))
def test_bytes_to_text(data, step):
    machine = bpe.ByteText()
    assert "".join(machine.feed(data[k : k + step]) for k in range(0, len(data), step)) + machine.finish() == data.decode("utf-8", "replace")


# --- fingerprints


def test_fingerprints(spark):
    values = texts(200, 4)
    rows = {r.doc_id: r for r in fingerprint.edited_neighbours(frame(spark, values)).collect()}
    full = [t or "" for t in values]
    errors = []
    for i, t in enumerate(full):
        after = full[(i + 1) % len(full)]
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            x, y = shingles(t, 5), shingles(other, 5)
            errors.append(near - (len(x & y) / len(x | y) if x | y else 1.0))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.2
    by = defaultdict(set)
    for i, t in enumerate(full):
        by[t].add(rows[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())


def test_one_document_and_none(spark):
    (r,) = fingerprint.edited_neighbours(frame(spark, ["abcdef"])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0
    assert fingerprint.edited_neighbours(frame(spark, ["a"]).limit(0)).count() == 0
    keyless = spark.createDataFrame([(None, "zz"), (5, "yy"), (5, "xx")], "doc_id long, text string")
    got = {(r.doc_id, r.edited_sha256) for r in fingerprint.edited_neighbours(keyless).collect()}
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in ((None, "zx"), (5, "xy"), (5, "yz"))}
    assert fingerprint.fingerprint_documents(frame(spark, ["a b", None])).columns == ["doc_id", "piece", "fingerprint"]


# --- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=40))
def test_plan_holds_everything(histogram):
    runs = packing.plan(histogram, 64, 6, 8)
    got = Counter()
    for count, contents in runs:
        assert count > 0 and sum(contents) <= 64
        for x in contents:
            got[x] += count
    assert got == Counter(histogram)


def test_plan_is_close_to_the_bound():
    r = random.Random(2)
    histogram = Counter(min(1024, int(r.lognormvariate(5.5, 1)) + 1) for _ in range(20_000))
    placed = []
    used = sum(c for c, _ in packing.plan(histogram, by_configuration=placed))
    assert used <= 1.002 * -(-sum(k * v for k, v in histogram.items()) // 1024)
    # the scheme places the large pieces, best fit the few that its integer parts leave
    large = sum(v for k, v in histogram.items() if 128 < k < 1024)
    assert 0.95 * large <= placed[0] <= large


def test_plan_of_all_groups_beside_a_session(spark):
    """512 groups are planned in the process that started the JVM, with a BLAS at its defaults, within a minute."""
    r = random.Random(1)
    histogram = Counter(min(1024, int(r.expovariate(1 / 400)) + 1) for _ in range(20_000))
    assert spark.range(1).count() == 1
    began = time.monotonic()
    runs = packing.plan(dict(histogram))
    assert time.monotonic() - began < 60
    assert sum(c for c, _ in runs) <= 1.001 * -(-sum(k * n for k, n in histogram.items()) // 1024) + 1


def test_inverses():
    r = np.random.default_rng(4)
    basis, gone = np.zeros((30, 30)), r.permutation(30)
    for j in range(30):
        basis[gone[j:], j] = r.integers(0, 3, 30 - j)
        basis[gone[j], j] = 1 + j % 3
    for found in (packing._triangular_inverse(basis, list(gone)), packing._inverse(basis)):
        assert np.allclose([[(basis[i] * found[:, j]).sum() for j in range(30)] for i in range(30)], np.eye(30))


def test_configurations_reach_the_fractional_optimum():
    # 100 pairs of 600 and 424, and 30 sequences of three times 341
    found = packing.configurations([600, 424, 341], [100, 100, 90], 1024)
    assert abs(sum(n for _, n in found) - 130) < 1e-6
    for k, n in enumerate((100, 100, 90)):
        assert abs(sum(c[k] * used for c, used in found) - n) < 1e-6
    assert all(600 * a + 424 * b + 341 * c <= 1024 for (a, b, c), _ in found)


@pytest.mark.parametrize("text", [" " * 10**6, "x" + " " * 10**6 + "y", "x" + " \n\t\u3000" * 250_000 + "y<|endoftext|>  z", "a" * 10**6 + "!" * 10**6, "q" + " " * 16_383 + "z", "q" + " " * 16_384 + "z"])
def test_encoder_on_long_runs(text):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert packing._Encoder()(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(spark, library):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    values = [*texts(), "a<|endoftext|>b", "wörd " * 4000]
    rows = packing.pack_documents(frame(spark, values)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(values):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids) and all(r.length == 1024 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(frame(spark, values).limit(0)).count() == 0


# --- FLAC


def payloads(values):
    return flac._payloads(pa.array(values, pa.string()))


def test_flac_roundtrip_and_seek():
    values = [t or "" for t in texts()] + ["\x00\x7f" * 700, "é" * 1000]
    data, offsets, sizes = payloads(values)
    media = flac.encode_streams(data, offsets)
    for i, blocks in enumerate(flac.decode_streams(media)):
        want = data[offsets[i] : offsets[i + 1]].tobytes()
        assert b"".join(x for _, x in blocks) == want and len(want) % 64 == 0 and sizes[i] == len(values[i].encode())
        assert [first for first, _ in blocks] == list(range(0, len(want), flac.BLOCK))
        assert flac.read_samples(media[i], 30, 1100) == want[30:1130]


def test_flac_of_a_long_text():
    """A stream of several batches of frames, among short ones, is read back byte for byte."""
    r = np.random.default_rng(3)
    long = bytes(r.integers(97, 123, 2_500_000, np.uint8)).decode()
    values = ["a", long, "", "b" * 3000]
    data, offsets, _ = payloads(values)
    for i, blocks in enumerate(flac.decode_streams(media := flac.encode_streams(data, offsets))):
        pcm = b"".join(x for _, x in blocks)
        assert pcm == data[offsets[i] : offsets[i + 1]].tobytes()
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        assert flac.feature(pcm) == f"samples={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))};peak={np.abs(x).max()}"
    assert flac.read_samples(media[1], 2_000_000, 100) == long[2_000_000:2_000_100].encode()


def test_flac_without_seek_table_and_damage():
    data, offsets, _ = payloads(["hello " * 600, "x"])
    media = flac.encode_streams(data, offsets)
    bare = []
    for m in media:
        size = int.from_bytes(m[43:46], "big")
        bare.append(m[:4] + b"\x80" + m[5:42] + m[46 + size :])
    assert [b"".join(x for _, x in b) for b in flac.decode_streams(bare)] == [b"".join(x for _, x in b) for b in flac.decode_streams(media)]
    start = flac.Stream(media[0]).first
    for place in (start, start + 5, start + 40, len(media[0]) - 1):
        broken = bytearray(media[0])
        broken[place] ^= 4
        with pytest.raises(ValueError):
            flac.decode_streams([bytes(broken)])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> (width - 1 - k) & 1 for k in range(width)]

    def frame(self, number, samples, body):
        head = bytes([0xFF, 0xF8, 0x74, 0x02 | 0, number, len(samples) - 1 >> 8, len(samples) - 1 & 255])
        crc = 0
        for b in head:
            crc = int(flac.CRC8[crc ^ b])
        data = head + bytes([crc]) + body
        crc = 0
        for b in data:
            crc = (crc << 8 & 0xFFFF) ^ int(flac.CRC16[crc >> 8 ^ b])
        return data + crc.to_bytes(2, "big")

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))


def rice(out, values, k):
    for v in values:
        u = 2 * v if v >= 0 else -2 * v - 1
        out.put(1, (u >> k) + 1)
        out.put(u & (1 << k) - 1, k)


@pytest.mark.parametrize("kind", ["constant", "verbatim", "fixed4", "fixed3", "lpc", "escape"])
def test_flac_subframes(kind):
    r = random.Random(kind)
    samples = [r.randrange(-100, 100) for _ in range(40)] if kind != "constant" else [7] * 40
    b = Bits()
    if kind == "constant":
        b.put(0, 8)
        b.put(7, 8)
    elif kind == "verbatim":
        b.put(1 << 1, 8)
        for x in samples:
            b.put(x & 255, 8)
    elif kind == "lpc":
        coefficients, shift = [9, -3, 2], 3
        b.put((32 + 2) << 1, 8)
        for x in samples[:3]:
            b.put(x & 255, 8)
        b.put(5 - 1, 4)
        b.put(shift, 5)
        for c in coefficients:
            b.put(c & 31, 5)
        b.put(0, 6)
        b.put(5, 4)
        rice(b, [samples[t] - (sum(c * samples[t - 1 - j] for j, c in enumerate(coefficients)) >> shift) for t in range(3, 40)], 5)
    else:
        order = {"fixed4": 4, "fixed3": 3, "escape": 1}[kind]
        rest = samples
        for _ in range(order):
            rest = [y - x for x, y in zip(rest, rest[1:], strict=False)]
        b.put((8 + order) << 1, 8)
        for x in samples[:order]:
            b.put(x & 255, 8)
        b.put(1, 6)  # two partitions
        cut = 20 - order
        for part in (rest[:cut], rest[cut:]):
            if kind == "escape":
                b.put(15, 4)
                b.put(10, 5)
                for v in part:
                    b.put(v & 1023, 10)
            else:
                b.put(6, 4)
                rice(b, part, 6)
    data = np.frombuffer(b.frame(0, samples, b.bytes()), np.uint8)
    got, sizes, number, ends = flac.decode_frames(data, np.array([0]), np.array([8]), np.array([40]))
    assert got[0, :40].tolist() == samples and (sizes[0], number[0], ends[0]) == (40, 0, len(data))


def test_media_columns(spark):
    values = texts()
    media = flac.encode_column(frame(spark, values))
    for r in flac.stored_features(media).collect():
        raw = (values[r.doc_id] or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:])) and r.feature == flac.feature(want)
    blocks = flac.decode_column(media.where("doc_id < 3")).orderBy("doc_id", "block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks if b.doc_id == 1).rstrip(b"\0") == values[1].encode() and blocks[0].piece == "own"
    assert flac.stored_features(media.limit(0)).count() == 0


# --- HTML


@pytest.mark.parametrize("source,text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("a<div>b</div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<b>x <i>y</b> z</i>", "x y z"), ("<b><p>x</b>y</p>", "xy"),
    ("<ul><li>one<li>two<ol start=3><li>a<li>b</ol></ul>", "- one\n- two\n  3. a\n  4. b"), ("<ol type=a reversed><li>x<li>y</ol>", "b. x\na. y"), ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=2>ab<tr><td>c<td>d</table>", "ab\nc   d"), ("<p hidden>x</p><p style='DISPLAY: none'>y</p>z", "z"), ("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span></div>", "b"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><template>t</template>x", "x"), ("<pre>\n a  b\n  c</pre>", " a  b\n  c"), ("<details>no<summary>s</summary>no</details>", "s"), ("<select><option>a<option selected>b</select>", "b"), ("<input type=hidden value=h><input value=v>", "v"),
    ("&lt;&amp;&eacute;&#x41;", "<&éA"), ("a<!-- x > y -->b<!DOCTYPE z>c", "abc"), ("x < y <3", "x < y <3"), ("a <b", "a"), ("<textarea>a <b>c</textarea>", "a <b>c"), ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("<blockquote>q</blockquote>", "  q"), ("</p>x", "x"), ("<td>x", "x"),
])
def test_render(source, text):
    assert render(source) == text


def test_extraction_is_bounded_and_keeps_columns(spark):
    assert render("<div>" * 30_000 + "x") == "x" and render("<a b='" * 30_000) == ""
    rows = spark.createDataFrame([(1, "u", "<p>Hi <b>you</b>", "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in extract_pages(rows).orderBy("page_id").collect()] == [(1, "u", "Hi you", 2), (2, None, "", 0)] and extract_pages(rows.limit(0)).count() == 0


# --- classifier


def test_weak_labels_find_the_accurate_labellers():
    r = np.random.default_rng(5)
    truth = r.random(4000) < 0.8
    votes = np.stack([np.where(r.random(4000) < miss, quality.NONE, np.where(r.random(4000) < right, truth, ~truth)) for right, miss in ((0.95, 0.1), (0.9, 0.3), (0.7, 0.2), (0.85, 0.5))], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates = quality.weak_labels(patterns, counts.astype(float))
    assert ((post[inverse.ravel()] > 0.5) == truth).mean() > 0.93
    accuracy = [rates[k, 1, 1] / (rates[k, 1, 0] + rates[k, 1, 1]) for k in range(4)]
    assert np.allclose(accuracy, [0.95, 0.9, 0.7, 0.85], atol=0.06)


def test_posteriors_by_brute_force():
    """The posterior of each pattern of votes is Bayes' rule with the rates that EM estimated from these posteriors."""
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.8
    votes = np.stack([np.where(r.random(4000) < 0.3, 2, np.where(r.random(4000) < p, truth, ~truth).astype(int)) for p in (0.9, 0.8, 0.7)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, rates = quality.weak_labels(patterns, counts.astype(float))
    good = sum(c * p for c, p in zip(counts, post, strict=True))
    prior = (good + 1) / (counts.sum() + 2)
    for pattern, p in zip(patterns.tolist(), post.tolist(), strict=True):
        x, y = prior, 1 - prior
        for k, v in enumerate(pattern):
            x, y = x * rates[k, 1, v], y * rates[k, 0, v]
        assert math.isclose(p, x / (x + y), rel_tol=1e-2, abs_tol=1e-6)
    # voters that agree with the truth more often are believed more
    assert rates[0, 1, 1] > rates[1, 1, 1] > rates[2, 1, 1]


def test_classifier_takes_repeated_and_null_keys(spark):
    rows = [(1, "good plain words stand here in a row " * 4)] * 60 + [(None, "@@@ ### $$$ " * 30)] * 40 + [(k, f"some other plain text number {k} goes on " * 3) for k in range(2, 60)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, votes string, row string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, quality.fit(docs, labels, sample=50)).collect()
    assert len(out) == len(rows) and len({r.quality_score for r in out if r.doc_id == 1}) == 1
    assert quality.keep_good(docs, quality.fit(docs, labels)).columns == docs.columns


def test_classifier_on_held_out_labels(spark):
    data = Path("/root/testdata/sf0.1")
    if not data.exists():
        pytest.skip("the synthetic tables aren't here")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 6000"), spark.read.parquet(f"{data}/labels.parquet")
    shown, hidden = labels.where("crc32(string(doc_id)) % 4 <> 0"), labels.where("crc32(string(doc_id)) % 4 = 0")
    rows = quality.classify(docs, quality.fit(docs, shown)).join(hidden, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(r.keep for r in good) >= 0.97 * len(good)
    for bad in ([r for r in rows if r.toxic == 1], [r for r in rows if r.quality == 0]):
        assert len(bad) > 20 and sum(not r.keep for r in bad) >= 0.9 * len(bad)


def test_classifier_edges(spark):
    docs = frame(spark, texts())
    model = quality.fit(docs)
    rows = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert rows[60].keep and rows[61].keep and rows[62].keep and len(rows) == 66
    assert quality.keep_good(docs, model).columns == docs.columns
    none = docs.limit(0)
    assert quality.classify(none, quality.fit(none)).count() == 0


def test_classifier_finds_a_rare_class(spark):
    data = Path("/root/testdata/sf0.1")
    if not data.exists():
        pytest.skip("the synthetic tables aren't here")
    rows = spark.read.parquet(f"{data}/documents.parquet").where("length(text) between 200 and 1500").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    rows = rows.where("toxic = 0").select("doc_id", "text", "quality", F.expr("pmod(xxhash64(doc_id), 100)").alias("part"))
    abuse = F.concat("text", F.lit(" zorgling vrimmel zorgling vrimmel"))
    few = rows.where("part < 2 and quality = 1").withColumn("text", abuse).select(F.col("doc_id") * 100, "text", "quality", F.lit(1)).toDF("doc_id", "text", "quality", "toxic").cache()
    many = rows.where("part < 80").select(F.explode(F.sequence(F.lit(1), F.lit(24))).alias("copy"), "*").select(F.col("doc_id") * 100 + F.col("copy"), "text", "quality", F.lit(0)).toDF("doc_id", "text", "quality", "toxic")
    docs = few.unionByName(many).cache()
    n, abusive = docs.count(), few.count()
    assert n > 8000 and 15 < abusive < n / 900
    # as many labels again say nothing of abuse
    labels = docs.select("doc_id", "quality", "toxic").unionByName(docs.select(-F.col("doc_id") - 1, F.lit(1), F.lit(None).cast("int")).toDF("doc_id", "quality", "toxic"))
    model = quality.fit(docs.select("doc_id", "text"), labels)
    hidden = rows.where("part >= 80 and quality = 1")
    good, bad = ([r.keep for r in quality.classify(x, model).collect()] for x in (hidden, hidden.withColumn("text", abuse)))
    assert len(bad) > 200 and sum(bad) <= 0.1 * len(bad), (n, abusive, len(bad), sum(bad))
    assert len(good) > 200 and sum(good) >= 0.97 * len(good), (len(good), sum(good))


def test_draw_rates_reach_rare_patterns():
    counts, numbers = np.array([900_000.0, 99_000, 970, 20, 10]), [np.array([0, 1, 2, 2, 2]), np.array([0, 0, 0, 1, 1])]
    rates = quality.draw_rates(counts, numbers, 8000)
    assert rates[3] == rates[4] == 1 and 7500 < (rates * counts).sum() <= 8000 and rates.min() >= 0.004
    assert (quality.draw_rates(counts, numbers, 1_000_000) == 1).all() and len(quality.draw_rates(np.zeros(0), [np.zeros(0, int)] * 2, 10)) == 0


def test_spans_cost_columns_not_cells():
    source = "<table>" + "<tr><td rowspan=1000 colspan=1000>x" * 2000 + "</table>"
    assert render(source).count("x") == 2000
    assert len(render("<table>" + "<tr><td rowspan=9 colspan=9>x" * 30 + "</table>").split("\n")) == 30


def test_wide_columns_are_wrapped_and_plaintext_is_text():
    lines = render("<table><tr><td>" + "word " * 30 + "<td>b<tr><td>c<td>d</table>").split("\n")
    assert [len(x) for x in lines[:1]] == [62] and lines[0].endswith("  b") and lines[-1] == "c".ljust(61) + "d"
    assert render("a<plaintext><b>x</b>\n</p>") == "a\n\n<b>x</b>\n</p>"
    assert render("<div>" * 2000 + "deep" + "</div>" * 2000 + "end") == "deep\nend"
