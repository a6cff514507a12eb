"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import os
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from examlake.llm.attribution import allotted, section_tokens, token_spans
from examlake.llm.audio import BLOCK, MELS, STEPS, audio_features, mel_of, samples, stored_features, stored_media, unpacked_tensors, wave
from examlake.llm.components import components
from examlake.llm.ctw import held_out, scored
from examlake.llm.decontamination import contaminated
from examlake.llm.mainhtml import extracted, main_text
from examlake.llm.minhash import near_duplicates, shingle_sets, super_minhash
from examlake.llm.packing import packed_sequences
from examlake.llm.shared import as_bytes, written
from examlake.llm.suffixes import repeated_strings
from examlake.llm.toxicity import Letters, clear, increasing, readings, restored, tokens, toxicity
from examlake.llm.warc import owned_records, read_archives, reading_tasks, record, write_archives

SYLLABLES = "th an er on re in ti es en at ed ha ou ing ion".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages, and the odd cases."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(3, 150)) for _ in range(n // 3)]
    passage = sentence(rng, 60)
    texts = list(base)
    for text in base:
        words = text.split()
        for at in rng.sample(range(len(words)), max(1, len(words) // 25)):
            words[at] = words[at].upper() + "x"
        texts.append(" ".join(words))
        texts.append(sentence(rng, 20) + "\n" + passage + " " + sentence(rng, 10))
    texts += [None, "", " \n\t", "one", "One", "two words", base[0], base[0], "aaaa" * 200, "é" * 150 + " ñandú € 漢字 \x85 x"]
    return list(enumerate(texts))


DOCS = "doc_id long, text string, source string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3 % 2}", "clash") for i, t in corpus()]
    return written(spark.createDataFrame(rows, DOCS).repartition(3), "docs"), rows


def words_of(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in found]


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(docs):
    df, rows = docs
    sets = {i: shingles_of(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_at_the_threshold_are_found(spark):
    """Pairs with a similarity from 0.75 to 0.8: all links are found, not only 0.9 of them; just below, none is made."""
    rng = random.Random(21)
    rows, expected = [], {}
    for k in range(150):
        words = sentence(rng, 120).split()
        other = list(words)
        while len(shingles_of(" ".join(words)) & shingles_of(" ".join(other))) >= 0.8 * len(shingles_of(" ".join(words)) | shingles_of(" ".join(other))):
            at = rng.randrange(0, len(words))
            other[at] += "q"
        a, b = shingles_of(" ".join(words)), shingles_of(" ".join(other))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        expected[2 * k + 1] = 2 * k if 100 * len(a & b) >= 75 * len(a | b) else 2 * k + 1
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i, c in expected.items() if c != i]
    assert len(linked) > 100 and all(got[i] == c for i, c in expected.items())


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 50, dtype=np.uint64)])) for _ in range(2))
    x, y, empty, tiny = super_minhash([a, b, a[:0], a[:2]])
    assert abs((x == y).mean() - 300 / 400) < 0.12
    assert (empty == np.iinfo(np.uint64).max).all() and not (tiny == np.iinfo(np.uint64).max).any()


def test_shingles_of_bytes_match_words():
    import pyarrow as pa

    texts = [t or "" for _, t in corpus()]
    data, offsets = as_bytes(pa.array(texts))
    assert [len(s) for s in shingle_sets(data, offsets)] == [len(shingles_of(t)) for t in texts]


def test_components_of_paths_and_loops(spark):
    edges = written(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (5, 5), (40, 38), (40, 39)], "a long, b long"), "edges")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 31: 30, 38: 38, 39: 38, 40: 38}


def repeats_by_brute_force(rows, width=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(raw[k : k + width])
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 5}, {"hot": 1, "chunks_a_part": 1}])
def test_repeated_strings_match_brute_force(spark, limits):
    rng = random.Random(9)
    shared, tail = sentence(rng, 25)[:95], "x" * 70 + sentence(rng, 20)
    rows = [*corpus(), *[(1000 + k, sentence(rng, 5) + " " + shared + " " + sentence(rng, 1) + (tail if k % 3 == 0 else "")) for k in range(40)], (None, sentence(rng, 40) + tail)]
    expected = repeats_by_brute_force(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **limits).collect()}
    assert got == expected
    assert sum(x[1] for x in expected.values()) > 1000


def test_string_ranks_are_byte_order():
    from examlake.llm.suffixes import string_ranks

    raw = bytes(random.Random(4).choices(b"ab", k=400)) + b"abab" * 60
    starts = np.arange(len(raw) - 99)
    strings = [raw[i : i + 100] for i in starts]
    assert string_ranks(np.frombuffer(raw, np.uint8), starts).tolist() == [sorted(set(strings)).index(x) for x in strings]


@pytest.mark.parametrize("limits", [{}, {"strings_a_task": 500, "merged_at_once": 2}])
def test_context_tree_weighting_matches_brute_force(docs, limits):
    df, rows = docs
    depth = 5
    tokens = {i: [w + b" " for w in words_of(t)] + [b"\n"] for i, t, *_ in rows}
    counts, nodes = Counter(), defaultdict(lambda: [0, 0])

    def bits(stream):
        padded = b"\n" * depth + stream
        for at in range(depth, len(padded)):
            for bit in range(8):
                yield padded[at - depth : at], 1 << bit | padded[at] >> (8 - bit), padded[at] >> (7 - bit) & 1

    for i, w in tokens.items():
        if not held_out(i):
            counts.update(w)
            for context, decision, bit in bits(b"".join(w)):
                for d in range(depth + 1):
                    nodes[context[depth - d :], decision][bit] += 1
    below = defaultdict(list)
    for context, decision in nodes:
        if context:
            below[context[1:], decision].append((context, decision))
    kt = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for k, (a, b) in nodes.items()}
    weighted, weight = {}, {}
    for d in range(depth, -1, -1):
        for k in nodes:
            if len(k[0]) == d:
                split = sum(weighted[c] for c in below[k]) if d < depth else kt[k]
                weighted[k] = np.logaddexp(kt[k], split) - math.log(2) if d < depth else kt[k]
                weight[k] = math.exp(kt[k] - math.log(2) - weighted[k]) if d < depth else 1.0
    total, distinct = sum(counts.values()), len(counts)
    for r in scored(df.repartition(9), **limits).collect():
        w, log10 = tokens[r.doc_id], 0.0
        for context, decision, bit in bits(b"".join(w)):
            p = None
            for d in range(depth, -1, -1):
                k = context[depth - d :], decision
                a = nodes.get(k, (0, 0))
                own = (a[bit] + 0.5) / (sum(a) + 1)
                share = weight.get(k, 1.0 if d == depth else 0.5)
                p = own if d == depth else share * own + (1 - share) * p
            log10 += math.log10(p)
        assert r.score == pytest.approx(log10, rel=1e-6)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id), len(w), sum(x in counts for x in w), total)


def test_packing_is_whole_gapless_and_in_proportion(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    df, rows = docs
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    source = {i: s for i, _, s, _ in rows}
    pieces = packed_sequences(df).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id]) and len(part) == p.length > 0
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1]) and sum(p.length for p in own) == len(ids[i])
    assert set(by_doc) == set(ids)
    everything, shares = sum(map(len, ids.values())), Counter()
    for i, x in ids.items():
        shares[source[i]] += len(x)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        size = sum(p.length for p in own)
        assert [p.offset for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1]) and size <= 1024 and size & (size - 1) == 0
        if size == 1024:
            held = Counter()
            for p in own:
                held[p.source] += p.length
            assert all(abs(held[s] - 1024 * n / everything) < 2 for s, n in shares.items())


def test_packing_to_targets(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 60), "abc"[i % 3]) for i in range(120)] + [(500 + i, "x", f"rare{i}") for i in range(5)] + [(None, sentence(rng, 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packed_sequences(docs, targets={"a": 0.5, "b": 0.25}).collect()
    total, size = Counter(), Counter()
    for p in pieces:
        total[p.source] += p.length
        size[p.sequence_id] += p.length
    held = defaultdict(Counter)
    for p in pieces:
        held[p.sequence_id]["rest" if p.source not in ("a", "b") else p.source] += p.length
    ends = 2 * total["a"] // 1024  # until then no source has run dry
    assert ends > 3 and all(abs(held[k][s] - 1024 * share) < 2 for k in range(ends) for s, share in (("a", 0.5), ("b", 0.25), ("rest", 0.25)))
    full = sum(size.values()) // 1024
    assert all(size[k] == 1024 for k in range(full)) and all(abs(held[k]["b"] - 512) < 2 for k in range(ends + 1, full) if held[k]["a"] == 0 and min(held[k]["b"], held[k]["rest"]) > 0 and k + 4 < full)
    assert {p.doc_id for p in pieces} == {r[0] for r in rows} and len({(p.doc_id, p.start) for p in pieces}) == len(pieces)
    with pytest.raises(ValueError, match="targets"):
        packed_sequences(docs, targets={"a": 0.9, "b": 0.2})


@pytest.mark.parametrize("seed", range(40))
def test_plans_leave_no_gap(seed):
    from fractions import Fraction

    from examlake.llm import packing

    rng = random.Random(seed)
    tokens = {f"s{i}": rng.choice([1, rng.randint(1, 100), rng.randint(1, 20_000)]) for i in range(rng.randint(1, 7))}
    parts = [rng.randint(1, 50) for _ in tokens]
    share = {n: Fraction(x, sum(parts) + seed % 3) for n, x in zip(tokens, parts, strict=True)}
    tokens[packing.REST] = rng.choice([0, 1, 5000])
    total, sequences, got = sum(tokens.values()), defaultdict(list), Counter()
    for name, queue in packing.plan(tokens, share | {packing.REST: 1 - sum(share.values())}).items():
        at = 0
        while at < tokens[name]:
            size = min(rng.randint(1, 3000), tokens[name] - at)
            for _, _, length, _, _, sequence, offset, _ in packing._cut(1, name, np.zeros(size, np.uint16).tobytes(), at, queue):
                sequences[sequence].append((offset, length))
                got[name] += length
            at += size
    assert got == Counter({n: t for n, t in tokens.items() if t})
    for sequence, pieces in sequences.items():
        pieces.sort()
        size = sum(n for _, n in pieces)
        assert [o for o, _ in pieces] == list(np.cumsum([0, *[n for _, n in pieces]])[:-1]) and size & (size - 1) == 0 and (size == 1024 if sequence < total // 1024 else size < 1024)


def test_section_tokens_match_offsets(spark):
    """Each section's tokens from the tokenizer's own offsets, by both rules."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    rows = [(i, "\n".join(sentence(rng, rng.randint(0, 9)) for _ in range(6)) + rng.choice(["", "é ñ", "漢字 x", "\n"])) for i in range(20)] + [(None, "a b\nc d"), (90, "")]
    cuts = [(i, c) for i in range(0, 20, 2) for c in (3, 7, 8, 11, 30)]
    docs, sections = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(cuts, "doc_id long, stop int")
    for rule in ("most", "first"):
        expected = {}
        for i, text in rows:
            ends = [c for d, c in cuts if d == i and c < len(text)] + [len(text)] if i is not None and i < 20 and i % 2 == 0 else ([m.end() for m in re.finditer("[^\n]*\n|[^\n]+", text)] or [0])
            starts, n = [0, *ends[:-1]], [0] * len(ends)
            for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
                inside = [min(b, e) - max(a, s) for s, e in zip(starts, ends, strict=True)]
                n[max(range(len(ends)), key=lambda k: (inside[k], -k)) if rule == "most" else next(k for k, e in enumerate(ends) if a < e)] += 1
            for k, e in enumerate(ends):
                expected[i, k] = (starts[k], e, n[k])
        got = {(r.doc_id, r.section): (r.start, r.stop, r.n_tokens) for r in section_tokens(docs, sections, rule).collect()}
        assert got == expected


def test_section_tokens_add_up(docs, spark):
    df, rows = docs
    got = section_tokens(df).collect()
    total = defaultdict(int)
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert all(total[r.doc_id] == r.doc_tokens for r in got)
    text = {i: t or "" for i, t, *_ in rows}
    assert Counter(r.doc_id for r in got) == {i: max(1, len(re.findall("[^\n]*\n|[^\n]+", t))) for i, t in text.items()}
    cut = spark.createDataFrame([(0, 3), (0, 3), (0, None), (0, 10_000), (1, -5)], "doc_id long, stop int")
    first = sorted((r.section, r.start, r.stop) for r in section_tokens(df, cut).where("doc_id = 0").collect())
    assert first == [(0, 0, 3), (1, 3, len(text[0]))]


def test_boundary_tokens_go_to_the_larger_part():
    ids, first, last = token_spans("Grüße, naïve 漢字!")
    assert first[0] == 0 and last[-1] == len("Grüße, naïve 漢字!") and (first < last).all() and (first[1:] <= last[:-1]).all()
    owner, crossing = allotted(np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([3, 7, 9]))
    assert owner.tolist() == [0, 1, 1] and crossing.tolist() == [False, True, True]
    assert allotted(np.array([2]), np.array([5]), np.array([3, 9]), "first")[0].tolist() == [0]


def test_audio_round_trip(docs):
    df, rows = docs
    stored = stored_features(stored_media(df)).cache()
    got = {r.doc_id: r for r in audio_features(stored).collect()}
    text = {i: (t or "").encode() for i, t, *_ in rows}
    assert set(got) == set(text)
    for i, r in got.items():
        payload = text[i] + b"\xff" * (-len(text[i]) % BLOCK or (0 if text[i] else BLOCK))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[i]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert samples(wave(payload))[1] == payload and r.media_sha256 == hashlib.sha256(wave(payload)).hexdigest() and f"blocks={len(payload) // BLOCK};" in r.feature
    by_payload = defaultdict(set)
    for r in got.values():
        by_payload[r.payload_sha256].add(r.feature)
    assert max(map(len, by_payload.values())) == 1
    for r in stored.collect():
        blocks = unpacked_tensors(r.tensors)
        assert blocks.schema.field("tensor").type.shape == [STEPS, MELS] and blocks.num_rows == r.payload_bytes // BLOCK
        assert blocks.column("start_ms").to_pylist() == [36.0 * k for k in range(blocks.num_rows)] and blocks.column("stop_ms")[-1].as_py() == 36.0 * blocks.num_rows


def test_audio_features_by_definition(spark):
    """Resampling as zero-stuffing, filtering and decimation; log-mel by a plain discrete Fourier transform."""
    from examlake.llm.audio import DOWN, FRAME, HOP, RATE, TAPS, UP, _phases, resampled

    text = sentence(random.Random(8), 250)
    (row,) = stored_features(stored_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    raw = text.encode() + b"\xff" * (-len(text) % BLOCK)
    x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    stuffed = np.zeros(len(x) * UP)
    stuffed[::UP] = x
    taps = np.zeros(UP * TAPS)
    for phase in range(UP):  # tap j of a phase weighs the input j - TAPS / 2 places from the output's
        taps[phase::UP] = _phases()[phase][::-1]
    full = np.convolve(stuffed, taps)
    y = resampled(x)
    at = np.arange(0, len(x) * UP, DOWN)
    assert np.allclose(y, full[at + UP * (TAPS - TAPS // 2 - 1)], atol=1e-9)
    rate, n = RATE * UP / DOWN, np.arange(FRAME)
    transform = np.exp(-2j * np.pi * np.outer(np.arange(FRAME // 2 + 1), n) / FRAME)
    edge = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * math.log10(1 + rate / 2 / 700), MELS + 2)]
    padded, mel = np.concatenate([y, np.zeros(FRAME)]), mel_of(row.tensors)
    for hop in (0, 3, len(mel) - 1):
        power = np.abs(transform @ (padded[hop * HOP : hop * HOP + FRAME] * (0.5 - 0.5 * np.cos(2 * np.pi * n / (FRAME - 1))))) ** 2
        for m in range(MELS):
            low, mid, high = edge[m : m + 3]
            weights = [max(0, min((f - low) / (mid - low), (high - f) / (high - mid))) for f in np.arange(FRAME // 2 + 1) * rate / FRAME]
            assert mel[hop, m] == pytest.approx(10 * math.log10(float(power @ weights) + 1e-9), abs=1e-3)


def test_resampled_tone_keeps_its_pitch():
    from examlake.llm.audio import DOWN, RATE, UP, log_mel, resampled, segments

    t = np.arange(BLOCK * 40) / RATE
    tone = np.sin(2 * np.pi * 1000 * t) * ((t > 0.4) & (t < 0.9))
    out = resampled(tone)
    spectrum = np.abs(np.fft.rfft(out))
    assert np.argmax(spectrum) * RATE * UP / DOWN / len(out) == pytest.approx(1000, abs=3)
    (span,) = segments(log_mel(out)).tolist()
    assert span[0] * 12 == pytest.approx(400, abs=30) and span[1] * 12 == pytest.approx(900, abs=30)


def test_archives_round_trip(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (1, "u\r\nx", "é <p>"), (2, "", None), (4, "u4", ""), (7, "u7", "x" * 40_000), (3, "u3", "same"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = write_archives(pages)
    got = sorted([(r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in read_archives(archives, split_bytes=97).collect()])
    assert got == sorted([(5, 4, "revisit", 3), (3, 4, "response", None), (9, 4, "revisit", 3), (1, 6, "response", None), (2, 0, "response", None), (4, 0, "revisit", 2), (7, 40_000, "response", None), (3, 4, "response", None), (-1, 4, "response", None)])
    assert read_archives(write_archives(pages.where("false"))).count() == 0
    assert {r.record_type for r in read_archives(write_archives(pages, least_bytes=5)).collect()} == {"response"}


def test_pages_fetched_again_keep_each_payload(spark):
    rows = [(1, "u", "A"), (2, "u", "A"), (2, "u", "B"), (3, "u", "C"), (4, "u", "B"), (5, "u", "A"), (5, "u", "C")]
    got = read_archives(write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    payloads = {hashlib.sha1(x.encode()).digest(): x for x in "ABC"}
    from base64 import b32decode

    assert sorted((r.page_id, payloads[b32decode(r.payload_digest)], r.refers_to or 0) for r in got) == [(1, "A", 0), (2, "A", 1), (2, "B", 0), (3, "C", 0), (4, "B", 2), (5, "A", 1), (5, "C", 3)]
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == [b"A", b"B", b"C"]


def test_archives_match_brute_force(spark):
    from base64 import b32encode

    rng = random.Random(5)
    payloads = ["", None, "a", "b" * 3000, "é", *[sentence(rng, 9) for _ in range(20)]]
    rows = [(i, f"u{i}", rng.choice(payloads)) for i in rng.sample(range(1000), 300)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(4)
    archives = write_archives(pages)
    first = {}
    for i, _, text in sorted(rows, key=lambda r: r[0]):
        first.setdefault(text or "", i)
    expected = {i: (len((t or "").encode()), b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), "response" if first[t or ""] == i else "revisit", None if first[t or ""] == i else first[t or ""]) for i, _, t in rows}
    read = read_archives(archives, split_bytes=200)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()} == expected and read.count() == 300
    assert reading_tasks(archives, 200) == 4 * spark.sparkContext.defaultParallelism == read.rdd.getNumPartitions()


def test_reader_passes_over_other_records(tmp_path, spark):
    import zlib as z

    def member(kind, more="", block=b"x"):
        packer = z.compressobj(6, z.DEFLATED, 31)
        return packer.compress(f"WARC/1.1\r\nWARC-Type: {kind}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()

    raw = member("warcinfo") + member("response", "WARC-Record-ID: <urn:uuid:1-2>\r\n", b"HTTP/1.1 200 OK\r\n\r\nhello") + member("request") + record(3, "u", b"p", None)
    (tmp_path / "b.warc.gz").write_bytes(raw)
    archives = spark.createDataFrame([(f"file://{tmp_path}/b.warc.gz", len(raw))], "path string, size long")
    assert sorted((r.page_id or 0, r.payload_bytes, bytes(r.payload)) for r in read_archives(archives).collect()) == [(0, 5, b"hello"), (3, 1, b"p")]


def test_malformed_and_damaged_records_are_rows(tmp_path, spark):
    import zlib as z

    def changed(raw, old, new):
        plain = z.decompress(raw, 31)
        assert old in plain
        packer = z.compressobj(6, z.DEFLATED, 31)
        return packer.compress(plain.replace(old, new, 1)) + packer.flush()

    good, urn = record(5, "u", b"payload", None), z.decompress(record(5, "u", b"payload", None), 31).split(b"WARC-Record-ID: <")[1].split(b"5>")[0]
    raw = changed(good, urn + b"5>", urn + b"abc>") + changed(good, urn + b"5>", urn + b"9" * 30 + b">") + changed(good, b"payload\r\n\r\n", b"pAyload\r\n\r\n") + changed(good, b"Content-Length: 7", b"Content-Length: x") + good
    (tmp_path / "c.warc.gz").write_bytes(raw)
    archives = spark.createDataFrame([(f"file://{tmp_path}/c.warc.gz", len(raw))], "path string, size long")
    rows = [(r.page_id, r.record_type, r.payload_bytes, r.payload and bytes(r.payload)) for r in read_archives(archives).collect()]
    assert sorted(rows, key=str) == sorted([(None, "response", 7, b"payload"), (None, "response", 7, b"payload"), (5, "damaged", 7, None), (5, "response", 7, b"payload"), (5, "response", 7, b"payload")], key=str)


def test_reader_owns_each_record_once_for_any_split(tmp_path):
    rng = random.Random(2)
    raw = b"junk\x1f\x8b\x08junk" + b"".join(record(i, f"u{i}", os.urandom(rng.randint(0, 3000)), None) for i in range(20)) + b"\x1f\x8b"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(raw)
    with path.open("rb") as source:
        for step in (61, 1000, len(raw)):
            found = [r["page_id"] for s in range(0, len(raw), step) for r in owned_records(source, s, min(s + step, len(raw)), len(raw), fetch=257)]
            assert found == list(range(20))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    rude = ["stupid", "idiot", "moron"]
    hidden = {"stupid": "5tup1d", "idiot": "i d i o t", "moron": "m0rooon"}
    rows, labels = [], []
    for i in range(600):
        words, toxic = sentence(rng, 30).split(), i % 4 == 0
        if toxic:
            w = rng.choice(rude)
            words.insert(rng.randrange(30), hidden[w] if i % 12 == 0 else w)
        rows.append((i, " ".join(words), "x"))
        labels += [(i, int(toxic))] * (1 + i % 2)
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x")], "doc_id long, text string, predicted string")
    got = toxicity(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")).collect()
    assert len(got) == 602 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    wrong = [r.doc_id for r in got if r.held_out and r.doc_id < 600 and r.predicted != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 2 and all(r.predicted == 0 and 0 <= r.score < 0.3 for r in got if r.doc_id >= 900)
    assert toxicity(docs.where("false"), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_lattice_decoding():
    model = Letters(Letters.of(Counter({"idiot": 50, "loser": 50, "hello": 50, "trash": 50})))
    assert [restored(x, model) for x in ("1d10t", "l.o.s.e.r", "heellllo", "7r@5h", "loser", "")] == ["idiot", "loser", "hello", "trash", "loser", ""]


def test_decoding_finds_the_best_of_all_paths():
    from examlake.llm import toxicity as t

    model = Letters(Letters.of(Counter({"idiot": 50, "loser": 20, "ill": 9})))

    def paths(signs, state, score, letters):
        if not signs:
            yield score + model.step(state, " "), letters
            return
        sign, rest = signs[0], signs[1:]
        if sign in t.UNSEEN:
            yield from paths(rest, state, score, letters)
            return
        arcs = [(sign, 0.0), *((x, t.RESEMBLES) for x in t.FOREIGN.get(sign, ""))] if sign.isalpha() else [(x, t.RESEMBLES) for x in t.LOOKALIKES.get(sign, "")] + [(sign, t.STANDS)] * (sign not in t.SEPARATORS)
        for letter, cost in arcs:
            yield from paths(rest, state[1] + letter, score + cost + model.step(state, letter), letters + letter)
            if letter == state[1]:
                yield from paths(rest, state, score + cost + t.REPEATS, letters)
        if sign in t.SEPARATORS:
            yield from paths(rest, state, score + t.SEPARATES, letters)

    rng = random.Random(2)
    for _ in range(60):
        token = "".join(rng.choice("idiot1!|.-0l7\u0456\u200b") for _ in range(rng.randint(1, 7)))
        score, letters = t._decoded(token, model)
        best = max(paths(token, "  ", 0.0, ""))
        assert score == pytest.approx(best[0]) and any(x == letters and s == pytest.approx(score) for s, x in paths(token, "  ", 0.0, ""))


def test_letters_of_other_scripts():
    model = Letters(Letters.of(Counter({w: 50 for w in ("idiot", "stupid")})))
    assert "stupid" in readings("\u0455tu\u0440id", model) and "idiot" in readings("i\u200bd\u0336iot", model)
    assert "stupid" in tokens("\uff33\uff34\uff35\uff30\uff29\uff24 x") and readings("\u0430\u0442\u0430\u043a\u0430", model) == {"\u0430\u0442\u0430\u043a\u0430"}


def test_tokens_with_several_readings():
    model = Letters(Letters.of(Counter({w: 50 for w in ("idiot", "stupid", "trash", "moron", "clown", "you", "hag")})))
    written_so = {"stuupid": "stupid", "trrash": "trash", "mooron": "moron", "!diot": "idiot", "|diot,": "idiot", "(lown": "clown", "idiot!": "idiot", "h a g": "hag", "a$$": "ass"}
    for token, word in written_so.items():
        assert token in tokens("x, " + token + " yz") or " " not in token
        assert word in readings(token, model), token
    assert [clear(x, model) for x in ("stuupid", "!diot", "(lown", "idiot!", "(trash)", "you")] == ["stupid", "idiot", "clown", "idiot", "trash", "you"]
    (run,) = (t for t in tokens("so y o u i d i o t there") if " " in t)
    assert {"you", "idiot"} <= readings(run, model)


def test_steps_never_fall():
    steps = increasing(np.array([0, 3, 1, 0, 9]), np.array([10, 4, 4, 0, 9]))
    assert steps == sorted(steps) and len(steps) == 5 and steps[:2] == [0, 0.5] and steps[-1] == 1


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href="/a">Menu</a></nav>
<div class="cookie-notice"><p>We use cookies, and more, and more.</p></div><div id="content"><h1>A &amp; B</h1><p><b>First,  paragraph of the
text, long enough to be one.<br><p>Second &eacute; one.<ul><li>an item<li>another</ul><form><p>Name</p></form></div>
<div class="comments"><p>Great, I, like, this, a lot, really, honestly, very much so.</p></div><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(PAGE).split("\n\n") == ["A & B", "First, paragraph of the text, long enough to be one.", "Second é one.", "an item", "another"]
    assert [main_text(x) for x in (None, "", "<nav><a>x</a></nav>", "<script>1", "just text", "<p>x <b>y")] == ["", "", "", "", "just text", "x y"]


_PROSE = "<p>" + "A long paragraph, with commas, and words. " * 6 + "</p>"


@pytest.mark.parametrize("name", ["post-comments", "main-menu", "sidebar-content", "cookie-text", "comments", "entry-footer", "related-posts", "nav_main"])
def test_names_of_what_is_no_article(name):
    part = f"<div class='{name}'><p>zzz some words, of others, and more, so that it counts.</p></div>"
    for page in (f"<article>{_PROSE}{part}{_PROSE}</article>", f"<div class='content'>{_PROSE}{_PROSE}</div>{part}"):
        assert "zzz" not in main_text(f"<body>{page}</body>") and "commas" in main_text(f"<body>{page}</body>")


@pytest.mark.parametrize("part", ['<h2 class="section-header">zzz</h2>', '<p class="tags">zzz</p>', '<p class="search">zzz</p>', '<div class="related-work"><p>zzz is related.</p></div>', '<div class="content-sidebar-wrap"><p>zzz, in a wrapper.</p></div>', '<div class="text no-sidebar"><p>zzz, alone.</p></div>'])
def test_names_of_parts_of_an_article(part):
    for tag in ("article", "div"):
        assert "zzz" in main_text(f"<body><{tag} class='content'>{_PROSE}{part}{_PROSE}</{tag}></body>")


def test_a_linked_line_is_text_and_several_are_a_menu():
    lone, menu = "<div><a href='x'>zzz a title</a></div>", "<div><a href='x'>zzz</a></div><div><a href='y'>yyy</a></div>"
    assert "zzz" in main_text(f"<body>{_PROSE}{lone}{_PROSE}</body>") and "zzz" not in main_text(f"<body>{menu}{_PROSE}{_PROSE}</body>")
    began = time.time()
    main_text("<body>" + _PROSE * 3000 + "<p>x y z</p>".join(["<div><a>q</a></div>"] * 20000) + "</body>")
    assert time.time() - began < 20


def test_main_text_keeps_parts_of_the_article():
    page = """<body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><article><header><h1>Title</h1></header><p>A paragraph, long enough, with commas, to be the article of this page.</p>
<figure><table><tr><td>cell<td>other</table><figcaption>A caption</figcaption></figure><figure><pre>x = 1</pre></figure><ul><li><a href="/r">First reference</a><li><a href="/s">Second reference</a></ul>
<div><a href="/t">One link</a></div></article><ul><li><a href="/m">Menu</a></ul><footer>f</footer></body>"""
    assert main_text(page).split("\n\n") == ["Title", "A paragraph, long enough, with commas, to be the article of this page.", "cell", "other", "A caption", "x = 1", "First reference", "Second reference", "One link"]


@pytest.mark.parametrize("seed", range(12))
def test_main_text_of_made_pages(seed):
    """Pages put together from an article that is known and parts that are none, with and without an article element."""
    rng = random.Random(seed)
    around, inside = rng.choice([("<article>", "</article>"), ('<div class="post-body">', "</div>"), ("<main><div>", "</div></main>"), ("<div><section>", "</section></div>")]), []
    body = ""
    for _ in range(rng.randint(4, 9)):
        text = sentence(rng, rng.randint(25, 60)) + ", so it is, and more"
        kind = rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<figure><figcaption>{}</figcaption></figure>"])
        body, inside = body + kind.format(text.replace(", so", ",&nbsp; so")), [*inside, text]
    noise = ["<nav><ul>" + "".join(f"<li><a href='/{w}'>{w}</a>" for w in sentence(rng, 6).split()) + "</ul></nav>", f"<aside><p>{sentence(rng, 20)}</p></aside>", f"<form><p>{sentence(rng, 9)}</p><input></form>",
             f"<div class='comments'><p>{sentence(rng, 40)}</p></div>", f"<script>if (a < b) '{sentence(rng, 5)}'</script>", f"<div id='cookie-notice'>{sentence(rng, 12)}</div>", "<!-- <p>no</p> -->", f"<footer>{sentence(rng, 8)}</footer>"]
    rng.shuffle(noise)
    page = "<html><body>" + "".join(noise[:4]) + around[0] + body + around[1] + "".join(noise[4:]) + "</body></html>"
    assert main_text(page).split("\n\n") == [re.sub(r"\s+", " ", x) for x in inside]


def test_pages_deep_or_left_open_take_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 10_000 + "x" + "</div>" * 10_000, "".join(f"<div>t{i}" for i in range(10_000)), "<b>" * 10_000 + "<div>y</div>" * 3000, "<a " * 300_000, '<a href="x> ' * 80_001, "<p title='it\">ok " * 50_000, "<!" * 400_000, "<div>" * 5000 + "</i></em></x>" * 20_000):
        main_text(page)
    assert time.time() - began < 20
    wrapped = "<body><form><div><article><h1>T</h1><p>One, two, and three.</p><input name=q><button>Go</button></article></div></form>"
    assert main_text(wrapped) == "T\n\nOne, two, and three."


def test_extracted_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = extracted(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.n_chars == 0 for r in got) == 2
    assert extracted(pages.where("false")).count() == 0


def test_pipeline_keeps_documents_without_words(spark):
    from corpus_pipeline import COLUMNS, cut_repeats

    text = sentence(random.Random(5), 60)
    rows = [(1, text), (2, text), (3, None), (4, ""), (5, " \n\t"), (6, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cut_repeats(spark, docs, "")
    assert got.columns == COLUMNS and sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(1, text, len(text)), (3, "", 0), (4, "", 0), (5, " \n\t", 3), (6, "one", 3)]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """A folder with documents that every stage has work on, and odd cases among them."""
    rng = random.Random(31)
    item = "when the old miller sells 12 sacks of flour for 30 coins each and buys 5 goats for 9 coins how much does the miller keep"
    passage = sentence(rng, 70)
    rows = [(i, sentence(rng, rng.randint(40, 90))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 20, 2)] + [(200 + i, sentence(rng, 30) + " " + passage + " " + sentence(rng, 20)) for i in range(6)]
    rows += [(300 + i, f"{sentence(rng, 20)} {item.replace('12', str(12 + i))} {sentence(rng, 20)}") for i in range(4)] + [(400 + i, " ".join(rng.sample(["stupid", "idiot", *sentence(rng, 30).split()], 32))) for i in range(12)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (None, sentence(rng, 50)), (504, rows[1][1]), (505, rows[1][1]), (1, rows[1][1]), (506, " ".join(sentence(rng, 2000) for _ in range(20)))]
    path = tmp_path_factory.mktemp("tables")
    docs = [(i, t, None if i == 3 else "en", None if i == 5 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, COLUMNS).withColumn("predicted", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash")).write.parquet(f"file://{path}/documents.parquet")
    labels = [(i, int("idiot" in (t or ""))) for i, t in rows if i is not None and i < 500]
    spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", item


def groups_by_brute_force(rows):
    sets = {i: shingles_of(t) for i, t in rows if i is not None}
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


def test_pipeline_stage_by_stage_matches_brute_force(spark, folder):
    import corpus_pipeline as c

    path, item = folder
    stages = dict(c.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    given = rows(docs)
    clean = written(stages["toxicity"](spark, docs, path), "t")
    kept = rows(clean)
    assert clean.columns == c.COLUMNS and {i for i, t in given if (i, t) not in kept} == {i for i, t in given if "idiot" in (t or "")}
    once = written(stages["near_duplicates"](spark, clean, path), "t")
    low = groups_by_brute_force(kept)
    assert sorted(rows(once), key=key) == sorted([(i, t) for i, t in kept if i is None or low[i] == i], key=key) and sum(low[i] != i for i in low) >= 10
    kept = rows(once)
    cut = written(stages["repeats"](spark, once, path), "t")
    seen, expected = set(), []
    for i, text in sorted(kept, key=key):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        rest = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode()
        if not any(gone) or rest.strip():
            expected.append((i, rest))
    assert sorted(rows(cut), key=key) == sorted(expected, key=key) and sum(len(t) for _, t in expected) < sum(len(t or "") for _, t in kept) - 300
    free = written(stages["decontamination"](spark, cut, path), "t")
    assert sorted(rows(free), key=key) == sorted([(i, t) for i, t in expected if i is None or not 300 <= i < 304], key=key)
    lengths = defaultdict(int)
    for p in stages["packing"](spark, free, path).collect():
        lengths[p.doc_id] += p.length
    from examlake.llm.encoding import encode

    total = defaultdict(int)
    for i, t in rows(free):
        total[i] += len(encode(t or "")) + 1
    assert lengths == total
    assert sum(r.length for r in c.run(spark, path).collect()) == sum(total.values())
    assert [stage(spark, docs.where("false"), path).count() for _, stage in c.STAGES] == [0] * 5


def template_of(text):
    """Words with marks, and their templates, by a walk over words instead of patterns."""
    from examlake.llm.decontamination import NAME, NUMBER, UNIT, UNITS

    text = re.sub(r"\s+", " ", text or "")
    text = re.sub(r"(?<=\d)[.,](?=\d)", "", text)
    words, out = [], []
    for m in re.finditer(r"[^\W_]+", text):
        before = text[max(0, m.start() - 2) : m.start()]
        named = len(m[0]) > 1 and m[0][0].isupper() and m[0][1].islower() and len(before) == 2 and before[1] == " " and (before[0].isalnum() or before[0] in ",;)")
        words.append((NAME if named else "") + m[0])
    for w in words:
        out.append(NAME if w[0] == NAME else NUMBER if w.isdigit() else UNIT if out and out[-1] == NUMBER and w.lower() in UNITS.split() else w.lower())
    return words, out


def contaminated_by_brute_force(docs, items):
    """Pairs found through windows: any one alignment, grid of alignments or whole document with enough windows and few conflicts; else the item's words in a row."""
    from examlake.llm import decontamination as d

    found = set()
    for doc, text in docs:
        words, template = template_of(text)
        plain = [w.lstrip(d.NAME).lower() for w in words]
        for item, wanted in items:
            texts = {0: wanted} | ({1: wanted.lower()} if d.NAME in template_of(wanted)[1] else {})
            windows = defaultdict(list)
            for form, form_text in texts.items():
                w, t = template_of(form_text)
                windows[form] = [(i, w[i : i + d.WINDOW], t[i : i + d.WINDOW]) for i in range(len(t) - d.WINDOW + 1)]
            few = lambda t: sum(x not in (d.NUMBER, d.NAME, d.UNIT) for x in t) < d.LEAST_PLAIN
            own = [w.lstrip(d.NAME).lower() for w in template_of(wanted)[0]]
            if own and sum(not few(t) for _, _, t in windows[0]) < d.LEAST_WINDOWS and any(plain[i : i + len(own)] == own for i in range(len(plain))):
                found.add((doc, item))
            w, t = (x[1 : d.WINDOW + 1] for x in template_of("x " + wanted))
            if t and t[0] == d.NAME and len(t) == d.WINDOW:  # within a sentence, the item's first word is a name
                windows[0].append((0, w, t))
            for usable in ([x for x in own_windows if not few(x[2])] for own_windows in windows.values()):
                places = defaultdict(list)
                for i, w, t in usable:
                    for k in range(len(template) - d.WINDOW + 1):
                        if template[k : k + d.WINDOW] == t:
                            for place in ((0, k - i), (1, (k - i) // d.WINDOW), (2, (k - i + d.WINDOW // 2) // d.WINDOW), (3, 0)):
                                places[place].append((i, k, w, t))
                for hits in places.values():
                    values = defaultdict(set)
                    for _, k, w, t in hits:
                        for j in range(d.WINDOW):
                            if t[j] in (d.NUMBER, d.NAME, d.UNIT):
                                values[t[j], w[j].lower()].add(words[k + j].lower())
                    if len({h[0] for h in hits}) >= min(d.LEAST_WINDOWS, len({u[0] for u in usable})) and sum(len(v) > 1 for v in values.values()) <= d.MOST_CONFLICTS * len(values):
                        found.add((doc, item))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_contamination_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    names, units = ["Tom", "Anna", "Maria", "Jim"], ["kg", "km", "dollars", "apples"]
    word = lambda: rng.choice([rng.choice(names), str(rng.randint(1, 50)), f"{rng.randint(1, 50)} {rng.choice(units)}", sentence(rng, 1), sentence(rng, 1), sentence(rng, 1), sentence(rng, 2)])
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 6, 9, 12, 25])))) for i in range(12)] + [(50, None), (51, "")]

    def changed(text):
        numbers, people = {}, {}
        text = re.sub(r"\d+", lambda m: numbers.setdefault(m[0], str(rng.randint(1, 50)) if rng.random() < 0.8 else m[0]), text)
        return " ".join(people.setdefault(w, rng.choice(names)) if w in names else w for w in text.split())

    docs = []
    for k in range(40):
        parts = [sentence(rng, rng.randint(0, 15))]
        for _ in range(rng.randint(0, 2)):
            text = rng.choice(items)[1] or ""
            text = rng.choice([text, changed(text), changed(text), text.lower(), " ".join(text.split()[: rng.randint(1, 12)])])
            parts += [text, rng.choice([text, changed(text), sentence(rng, 9)])]
        docs.append((k, " ".join(parts) if k % 9 else "\n".join(parts)))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = contaminated_by_brute_force(docs, [(i, t) for i, t in items if t])
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(expected) > 10


def test_contamination_by_templates(spark):
    item = "When Tom Baker buys 12 apples and 5 kg of pears he pays Anna exactly 40 dollars so what does Tom pay for 3 apples and will Tom then be glad"
    changed = "Intro. Now When Jim Baker buys 17 apples and 8 lb of pears he pays Mary exactly 31 euros so what does Jim pay for 6 apples and will Jim then be glad ok"
    clash = "Intro. Now When Jim Baker buys 17 apples and 8 lb of pears he pays Jim exactly 31 euros so what does Kim pay for 17 apples and will Jim then be glad ok"
    docs = [(1, "x y " + item), (2, changed), (3, "nothing of the kind " * 9), (4, None), (5, ""), (6, "short"), (1, "x y " + item), (7, clash)]
    got = {r.doc_id: r for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item), (9, item), (8, None), (7, "too short")], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 7} and got[1].n_changed == 0 and got[2].n_changed >= 5 and got[2].n_conflicts == 0 and got[7].n_conflicts == 1
    assert contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_contamination_by_occurrence(spark):
    shops = "the first shop sells 12 red balls for 3 dollars each and the second shop sells 15 red balls for 4 dollars each"
    other = "the first shop sells 22 red balls for 7 dollars each and the second shop sells 35 red balls for 9 dollars each"
    inserted = shops.replace("each and the", "each and so the")
    mixed = "the first shop sells 12 red balls for 3 dollars each or not. Then " + other
    docs = [(1, "Intro. " + shops + " end"), (2, "Intro. " + other + " then more. Now " + shops), (3, inserted), (4, mixed), (5, "x " * 50)]
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, shops)], "item_id long, text string")).collect()
    got = {r.doc_id: r for r in rows}
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4]
    assert got[1].coverage == 1 and got[1].n_changed == got[1].n_conflicts == 0 and got[2].n_changed == got[2].n_conflicts == 0


def test_contamination_of_items_with_few_windows(spark):
    items = {1: "Compute 12 + 15 + 18 + 21 + 24 + 27 + 30", 2: "What is the capital of Peru?", 3: "The Old Man And The Sea By Ernest Hemingway Wins", 5: "", 6: None,
             4: "when the teacher asked 5 of 9 kids 12 + 15 + 18 + 21 + 24", 7: "so then old Tom Baker went to see Anna in Lima and Paul in Cusco before he paid Maria for all"}
    texts = {1: "x y " + items[1], 2: "ask what is the\ncapital of  peru ok", 3: "we read: " + items[3], 4: "now " + items[4].replace("9", "8") + " end", 5: "",
             7: items[7].replace(" Anna", "\nAnna").replace(" Cusco", "  Cusco"), 8: items[7].lower(), 9: "compute 12 15 18 21 24 27 31 what is the capital of Chile"}
    got = contaminated(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4), (7, 7), (8, 7)]
    assert {r.doc_id: r.coverage for r in got}[7] == 1


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts longer than a chunk, twice, beside a null id, and columns whose names operators use themselves."""
    rng = random.Random(77)
    text = " ".join(sentence(rng, 5000) for _ in range(110))
    rows = [(1, text), (2, text + " end"), (None, "a b c d e f"), (4, "x" * 1_500_000), (5, None)]
    clash = "'x' as score, 'x' as media, 'x' as bands, 'x' as text_, 'x' as chunk, 'x' as words, 'x' as hash, 'x' as ends, 'x' as part, 'x' as predicted, 'x' as toxic, 'x' as n"
    assert len(text) > 3 << 20
    return written(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source", *clash.split(", ")), "long"), {i: t or "" for i, t in rows}


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op10"])
def test_very_long_texts(spark, long_docs, name):
    df, text = long_docs
    long = text[1]
    if name == "op2":
        got = {r.doc_id: r.predicted for r in toxicity(df, spark.createDataFrame([(1, 0), (2, 1), (4, None)], "doc_id long, toxic int")).collect()}
        assert set(got) == set(text)
    elif name == "op3":
        got = {r.doc_id: r.n_tokens for r in scored(df).collect()}
        assert got == {i: len(words_of(t)) + 1 for i, t in text.items()}
    elif name == "op4":
        got = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeated_strings(df).collect()}
        assert got[1][1] == 0 and got[2] == (len(long) + 4, len(long)) and got[4] == (1_500_000, 1_500_000 - 1) and got[None][1] == got[5][0] == 0
    elif name == "op5":
        item = " ".join(long.split()[40_000:40_030])
        got = {(r.doc_id, r.item_id) for r in contaminated(df, spark.createDataFrame([(9, item, "x"), (None, None, "y")], "item_id long, text string, hash string")).collect()}
        assert got == {(1, 9), (2, 9)}
    elif name == "op6":
        total = defaultdict(int)
        for r in section_tokens(df).collect():
            total[r.doc_id] += r.n_tokens
            assert r.doc_tokens > 0 or r.doc_id == 5
        assert set(total) == set(text) and total[2] > total[1] > 500_000
    elif name == "op7":
        got = {r.doc_id: (r.n_bytes, r.payload_bytes % BLOCK) for r in audio_features(stored_features(stored_media(df))).collect()}
        assert got == {i: (len(t), 0) for i, t in text.items()}
    elif name == "op8":
        pieces = packed_sequences(df).collect()
        size = Counter()
        for p in pieces:
            size[p.doc_id] += p.length
        assert all(size[p.doc_id] == p.doc_tokens for p in pieces) and set(size) == set(text)
    else:
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
        assert got[2][1:] == (1, False) and got[None] == (2, None, True) and got[4] == (1, 4, True) and got[5] == (0, 5, True) and got[1][0] > 500_000


def test_very_long_pages(spark):
    body = "".join(f"<p>{w}, and more of the same kind" for w in sentence(random.Random(3), 60_000).split())
    pages = spark.createDataFrame([(1, "u", f"<article>{body}</article>"), (2, None, f"<article>{body}</article>"), (None, "v", "<p>x")], "page_id long, url string, html string").selectExpr("*", "'x' as text", "'x' as key", "'x' as refers_to", "'x' as n_chars", "'x' as salt")
    got = {r.page_id: r.n_chars for r in extracted(pages).collect()}
    assert got[1] == got[2] > 2_000_000 and got[None] == 1
    read = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in read_archives(write_archives(pages), payloads=False).collect()}
    assert read == {1: ("response", None, len(body) + 19), 2: ("revisit", 1, len(body) + 19), None: ("response", None, 4)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    for run in (near_duplicates, repeated_strings, scored, packed_sequences, section_tokens, lambda d: audio_features(stored_features(stored_media(d)))):
        assert run(none).count() == 0
