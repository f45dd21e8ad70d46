"""The operators of the training-data subpackage against brute force and exact round trips, on small odd inputs."""

import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, row int, component_id string"


def docs(spark, rows):
    """Documents with further columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, lang, "s", None, "x", 1, "y") for i, t, lang in rows], SCHEMA)


def prose(r, n, lang=0):
    parts = (["th", "in", "er", "the", "and", "ou"], ["ch", "ein", "ung", "der", "und", "ß"])[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(n))


ODD = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (4, "one", "en"), (None, "no id at all", "en"), (5, "é" * 5000 + " 漢字 😀", "de"), (6, "a b " * 3000, "en")]


# -- packing and token files ----------------------------------------------------------------------


@functools.cache
def reference(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def reference_ids(name, text):
    return reference(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder_equals_the_tokenizer(name):
    import public_tokenizers

    from oddsmill.llm._tokens import WordCachingEncoder

    r = random.Random(2)
    bits = ["a", "b", "'s", " ", "  ", "\n", " \n", "\t", "\u00e9", "e\u0301", "\u00a0", "\u2003", "\u200a", "\u3000", "\u1680", "\x1c", "\x85", "1", "!", "?!", "\u03a3", "\u00df", "A\u00e9 ", "<|endoftext|>", "<|startoftext|>", "\x01", "\x00", "\u6f22", "\U0001f600", ".", ",", "|", "\u3002"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(1500)] + ["x" * 3000, "the end. The" * 200]
    enc = WordCachingEncoder(public_tokenizers.path(name), max_words=100)
    for k in (0, 1):  # from an empty cache, then from a full one
        ids, starts = enc.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [reference_ids(name, t) for t in texts], k
    assert enc.encode([])[1].tolist() == [0] and enc.encode_with_end([b"", b""], 7)[0].tolist() == [7, 7]


def test_packing_keeps_every_id_in_order(spark):
    from oddsmill.llm.packing import default_tokenizer, digest, pack_documents

    r = random.Random(1)
    rows = ODD + [(i, prose(r, r.randrange(1, 900)), "en") for i in range(10, 60)]
    packed = digest(pack_documents(docs(spark, rows), default_tokenizer(), pieces_per_group=16)).collect()
    assert len({(p.sequence_id, p.offset) for p in packed}) == len(packed)
    by_doc, by_sequence = {}, {}
    for p in packed:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, t, _ in rows:
        ids = [*reference_ids("byte_bpe_50k.json", t), 0]
        copies = sum(i == x for x, _, _ in rows)
        pieces = by_doc[i]
        assert sum(p.length for p in pieces) == len(ids) * copies
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(docs(spark, []), default_tokenizer()).count() == 0


def test_first_fit_decreasing_equals_a_scan():
    from oddsmill.llm.packing import first_fit_decreasing

    r = random.Random(4)
    for n in (0, 1, 7, 60):
        sizes = [r.randrange(1, 101) for _ in range(n)]
        bins, want = [], [None] * n
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            k = next((k for k, used in enumerate(bins) if used + sizes[i] <= 100), len(bins))
            if k == len(bins):
                bins.append(0)
            want[i] = (k, bins[k])
            bins[k] += sizes[i]
        assert first_fit_decreasing(sizes, 100) == want


def test_token_blocks_round_trip(spark):
    import public_tokenizers

    from oddsmill.llm.token_file import BlockReader, encode_block, read_documents, tokens_at, write_token_blocks

    ids = np.array([0, 1, 255, 256, 65535, 65536, 2**32 - 1, 7] * 200, np.uint32)
    reader = BlockReader(encode_block(ids))
    assert reader.all().tolist() == ids.tolist() and [reader[i] for i in range(len(reader))] == ids.tolist() and reader.take(np.arange(len(ids))[::-1]).tolist() == ids[::-1].tolist()
    path = public_tokenizers.path("word_bpe_49k.json")
    got = read_documents(write_token_blocks(docs(spark, ODD), path, ids_per_block=50)).collect()
    at = 0
    for row in sorted(got, key=lambda x: x.start):
        texts = [t for i, t, _ in ODD if i == row.doc_id]
        want = [*reference_ids("word_bpe_49k.json", texts[0]), 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert [x.doc_id for x in sorted(got, key=lambda x: x.start)] == sorted((i for i, _, _ in ODD), key=lambda i: (i is not None, i))
    assert read_documents(write_token_blocks(docs(spark, []), path)).count() == 0
    whole = [x for row in sorted(got, key=lambda x: x.start) for x in [*reference_ids("word_bpe_49k.json", next(t for i, t, _ in ODD if i == row.doc_id)), 2]]
    blocks = write_token_blocks(docs(spark, ODD), path, ids_per_block=900, bytes_per_range=4000)
    asked = [0, 1, 5, 5, len(whole) - 1, len(whole), *range(7, len(whole), 97)]
    found = tokens_at(blocks, spark.createDataFrame([(p,) for p in asked], "position long"), span=500).collect()
    assert sorted(map(tuple, found)) == sorted((p, whole[p]) for p in asked if p < len(whole))


# -- quality --------------------------------------------------------------------------------------


def brute_quality(t, least):
    w = WORD.findall(t or "")
    n = len(w)
    longest = [max((next((k for k in range(n - max(i, j)) if w[i + k] != w[j + k]), n - max(i, j)) for j in range(n) if j != i), default=0) for i in range(n)]

    def cover(f):
        return len({p for i, x in enumerate(longest) for p in range(i, i + f(x))})

    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), cover(lambda x: 3 if x >= 3 else 0), cover(lambda x: x if x >= least else 0), max([x for x in longest if x >= least], default=0))


def test_quality_equals_brute_force(spark):
    from oddsmill.llm.quality import accepted, quality

    r = random.Random(3)
    rows = [x for x in ODD if len(x[1] or "") < 2000] + [(i, "".join(r.choice(["a", "b", "é", "c#", " ", "\n", " a b ", "|", "\t"]) for _ in range(r.randrange(90))), None) for i in range(10, 150)]
    rows += [(200, prose(r, 120), "en"), (201, prose(r, 40) + "\n" + prose(random.Random(9), 60) + "\n" + prose(random.Random(9), 60), "en")]
    texts = {i: t for i, t, _ in rows}
    got = quality(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for q in got:
        want = brute_quality(texts[q.doc_id], 10)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.covered_words, q.longest_repeat) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert q.base_failed == failed
        assert q.kept == (not failed and want[5] <= 0.3 * want[0] and want[6] <= 0.2 * want[0])
    kept = accepted(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and sorted(x.doc_id for x in kept.collect()) == sorted(q.doc_id for q in got if q.kept)
    assert quality(docs(spark, [])).count() == 0


# -- near duplicates ------------------------------------------------------------------------------


def brute_components(rows, words=4, percent=85):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").encode().lower().decode())
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    of = list(range(len(rows)))

    def find(a):
        while of[a] != a:
            a = of[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                of[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("how", [{}, {"leaf": 2}, {"leaf": 2, "max_nodes": 6, "max_hot": 0}, {"leaf": 4, "max_shingles": 300}])
def test_jaccard_join_equals_brute_force(spark, how):
    from oddsmill.llm.jaccard_join import join_components, representatives

    r = random.Random(8)
    rows = list(ODD)
    for g in range(8):
        base = prose(r, r.choice([6, 40, 90, 150])).split()
        for k in range(r.choice([1, 2, 12])):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = prose(r, 1).upper()
            rows.append((100 * g + 10 + k, " ".join(w), "en"))
    rows += [(9000, rows[-1][1], "en"), (9001, rows[-1][1].upper(), "en"), (9002, rows[-1][1], "en")]
    got = join_components(docs(spark, rows), local_hot=3, **how).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows), key=key)
    assert join_components(docs(spark, [])).count() == 0
    best = {}
    for (i, t, _), (_, n, c) in zip(rows, brute_components(rows, 5, 80), strict=True):
        best.setdefault(c if n else ("no words", len(best)), (i, t))
    assert Counter(x.doc_id for x in representatives(docs(spark, rows)).collect()) == Counter(c if isinstance(c, int) or c is None else i for c, (i, _) in best.items())


def test_region_joins_equal_all_pairs():
    """Chains of copies cut short, and a crowd that shares one passage: windows must keep each link, blocks each pair."""
    from oddsmill.llm.jaccard_join import Region

    r = np.random.default_rng(5)
    sets = [np.arange(n, dtype=np.uint64) for n in (100, 90, 80, 71)]
    sets += [np.unique(np.concatenate([np.arange(1000, 1040, dtype=np.uint64), r.integers(2000, 9000, 30).astype(np.uint64)])) for _ in range(40)]
    for _ in range(60):
        s = sets[r.integers(len(sets))]
        sets.append(np.unique(np.concatenate([s[r.random(len(s)) > 0.06], r.integers(10_000, 99_999, r.integers(1, 6)).astype(np.uint64)])))
    want = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(x, sets[j]))
            if 100 * shared >= 85 * (len(x) + len(sets[j]) - shared):
                a, b = want[i], want[j]
                want = [min(a, b) if w in (a, b) else w for w in want]
    for leaf in (2, 16, 1000):
        region = Region(sets, 85, leaf, 8)
        links = dict(region.links())
        assert [links.get(i, i) for i in range(len(sets))] == want


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (3, 55)])
def test_linked_sets_share_a_first_signature(words, percent):
    from oddsmill.llm.jaccard_join import SizeClasses

    r = np.random.default_rng(6)
    classes, none = SizeClasses(percent), np.zeros(0, np.uint64)
    for n in [*range(1, 40), 60, 135, 136, 500, 3000]:
        for _ in range(4):
            x = np.unique(r.integers(0, 2**64, n, np.uint64))
            y = x[: max(1, len(x) - r.integers(0, max(1, round(n * (1 - percent / 100)) + 1)))]
            y = np.unique(np.concatenate([y, r.integers(0, 2**64, r.integers(0, max(1, n // 8) + 1), np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if 100 * shared >= percent * (len(x) + len(y) - shared) and (len(x) != len(y) or shared < len(x)):
                sig, of = classes.first(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), none, none)
                assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


@pytest.mark.parametrize("percent", [55, 80, 85])
def test_parities_part_sets_by_chance_alike_and_no_links(percent):
    """Sets that share a passage are parted; links, also chains between sets of other sizes, stay in one group."""
    from oddsmill.llm.jaccard_join import parities, possible_groups

    r = np.random.default_rng(9)
    draw = lambda n: np.unique(r.integers(0, 2**64, n, np.uint64))
    passage = draw(60)
    sets = [np.unique(np.concatenate([passage, draw(n)])) for n in r.integers(300, 900, 60)] + [draw(n) for n in (1, 2, 5, 64, 65)]
    alone = len(sets) - 5
    for _ in range(150):
        s = sets[r.integers(len(sets))]
        sets.append(np.unique(np.concatenate([s[r.random(len(s)) > r.choice([0, 0.03, 0.1])], draw(int(r.integers(0, 1 + len(s) // 10)))])) if len(s) > 1 else s)
    bits = [np.frombuffer(parities(s), np.uint64) for s in sets]
    groups = possible_groups(np.array([len(s) for s in sets]), bits, percent)
    of = {int(i): k for k, g in enumerate(groups) for i in g}
    assert len(of) == sum(map(len, groups)) and all(len(g) > 1 for g in groups)
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(x, sets[j]))
            if 100 * shared >= percent * (len(x) + len(sets[j]) - shared):
                assert of[i] == of[j]
    if percent >= 80:
        assert possible_groups(np.array([len(s) for s in sets[:alone]]), bits[:alone], percent) == []


def test_tables_of_the_join_go_when_its_rows_are_written(spark):
    from oddsmill.llm.jaccard_join import representatives
    from oddsmill.sources import tables

    r = random.Random(4)
    rows = [(k, prose(r, 80), "en") for k in range(6)]
    with tables.listed_scratch() as paths:
        kept = representatives(docs(spark, [*rows, *[(10 + i, t + " more", "en") for i, t, _ in rows]]))
    there = lambda p: tables.ensure_dir(spark, p.rpartition("/")[0])[0].exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert [p.rpartition("/")[2].rpartition("-")[0] for p in paths if there(p)] == ["join-rows"]
    assert sorted(x.doc_id for x in kept.collect()) == list(range(6))


def test_a_repeated_id_loses_only_its_copies(spark):
    from oddsmill.llm.jaccard_join import representatives

    r = random.Random(13)
    copied, clean = prose(r, 30), prose(r, 30)
    rows = [(1, copied, "en"), (2, copied, "en"), (2, clean, "en"), (None, copied, "en"), (None, prose(r, 30), "en")]
    got = [(x.doc_id, x.text) for x in representatives(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([rows[0][:2], rows[2][:2], rows[4][:2]], key=str)
    rows = [(1, copied, "en"), (1, copied, "en"), (None, clean, "en"), (None, clean, "en"), (None, None, "en"), (None, None, "en")]
    assert Counter(x.text for x in representatives(docs(spark, rows)).collect()) == {copied: 1, clean: 1, None: 2}


# -- decontamination ------------------------------------------------------------------------------


def edits(a, b):
    """Fewest edits between a and any passage of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_within_the_budget_are_found(spark):
    from oddsmill.llm.decontaminate import leaks, without_leaks

    r = random.Random(6)
    items = [(k, prose(r, 30)[:150]) for k in range(6)] + [(90, None), (91, ""), (92, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, planted = list(ODD), set()
    for i in range(100, 130):
        k = i % 6
        budget = int(0.08 * len(items[k][1].strip()))
        s = list(items[k][1])
        for _ in range(r.randrange(budget + 1)):
            p = r.randrange(len(s))
            r.choice([lambda s=s, p=p: s.insert(p, "q"), lambda s=s, p=p: s.pop(p), lambda s=s, p=p: s.__setitem__(p, "ü")])()
        rows.append((i, prose(r, 50) + " " + "".join(s).upper() + "\n\n" + prose(r, 50), "en"))
        planted.add((i, k))
    rows += [(i, prose(r, 80), "en") for i in range(200, 220)] + [(300, "has TINY in it", "en")]
    found = leaks(docs(spark, rows), bench, max_chars=400).collect()  # several blocks
    got = {(x.doc_id, x.item_id) for x in found}
    assert planted <= got and (300, 92) in got
    fold = lambda t: re.sub(r"\s+", " ", t.lower())
    texts = {i: t for i, t, _ in rows}
    for x in found:
        assert edits(fold(items[x.item_id][1] if x.item_id < 90 else "tiny").strip(), fold(texts[x.doc_id])[:900]) <= 12 or x.doc_id in (5, 6)
        assert edits(fold(dict(items)[x.item_id]).strip(), fold(texts[x.doc_id][x.start : x.end])) <= x.edits
    clean = without_leaks(docs(spark, rows), bench, max_chars=400)
    bad = {i for i, _ in got}
    assert sorted((x.doc_id or -1) for x in clean.collect()) == sorted((i or -1) for i, _, _ in rows if i not in bad)
    assert leaks(docs(spark, []), bench).count() == 0 and leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_leaks_equal_an_exhaustive_search():
    """Every pair of a small text and a small item, repetitive ones too, in small batches of pairs of places."""
    from oddsmill.llm.decontaminate import Items, fold

    r = random.Random(16)
    unit = lambda n: "".join(r.choice("abcde ") for _ in range(n)).strip() or "x"
    items = [(k, unit(r.randrange(20, 60))) for k in range(12)] + [(20, "ab " * 12), (21, "abc" * 14 + unit(12)), (22, "tiny"), (23, "a" * 40), (24, unit(40) + "xy" * 11)]
    block = Items.of(items, 4, 0.12)
    assert {20, 23} <= {block.ids[k] for k in block.repetitive}
    texts = [None, "", "tiny", "atiny tinyb"]
    for _ in range(120):
        t = list(r.choice(items)[1])
        for _ in range(r.randrange(7)):
            p = r.randrange(len(t))
            t[p : p + r.randrange(2)] = r.choice(["", "z", "q"])
        texts.append(unit(r.randrange(30)) + "".join(t) + r.choice([unit(20), "ab " * r.randrange(9), "a" * r.randrange(50)]))
    found = block.find(texts)
    got = {(d, i) for d, i, *_ in found}
    for d, t in enumerate(texts):
        for k, i in enumerate(block.ids):
            text, item = "".join(map(chr, fold(t or "")[0])), "".join(map(chr, block.texts[k]))
            assert ((d, i) in got) == (edits(item, text) <= block.budgets[k]), (t, item)
    of = dict(items)
    for d, i, start, end, n in found:
        assert edits(re.sub(r"\s+", " ", of[i]).strip(), re.sub(r"\s+", " ", texts[d][start:end])) == n or n >= 0
        assert len(texts[d][start:end]) <= 1.2 * len(of[i]) + 3
    assert block.find([]) == []
    whole, parts = {tuple(x) for x in block.candidates(*hits_of(block, texts))}, {tuple(x) for x in block.candidates(*hits_of(block, texts), most=50)}
    assert whole == parts


def hits_of(block, texts):
    from oddsmill.llm.decontaminate import fold, qgrams

    g = qgrams(fold("\0".join(t or "" for t in texts))[0], block.q)
    return np.arange(len(g)), g


def test_repetitive_items_take_time_in_proportion():
    from oddsmill.llm.decontaminate import Items

    block = Items.of([(1, "la la land " * 270)], 10, 0.08)
    start = time.perf_counter()
    found = block.find(["la la land " * 2700, "la la land " * 100])
    assert found and {d for d, *_ in found} == {0} and time.perf_counter() - start < 8


# -- secrets --------------------------------------------------------------------------------------


def brute_spans(t):
    key = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_spans(spark):
    from oddsmill.llm.secrets import digest, redact, scan

    r = random.Random(5)
    bits = ["token", "Token: ", "secret=", "api_key", "APIKEY = '", '"', "password", ": ", "abcdefgh", "tok", "AKIA", "ABCDEFGHIJ12", "0123456789abcdef" * 2, "é", "😀 ", " ", "\n", "x=", "ff"]
    rows = list(ODD) + [(i, "".join(r.choice(bits) for _ in range(r.randrange(30))), None) for i in range(10, 200)]
    any64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(any64) for _ in range(n)) for n in (47, 24, 36)]
    rows += [(500 + k, f"see {x} there", "en") for k, x in enumerate(keys)]
    plain = ["https://example.com/Blog/2024/05/my-Long-Title-About-cats", "theLongNameOfSomeFunctionInACode12", "Xyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxy12", "thandintheandtheren12", "MAX_NUMBER_OF_OPEN_FILES_2", "Donaudampfschifffahrtsgesellschaft", "2024-05-17T10-15-30-Z-backup-of-The-day", "McDonaldAndTheOtherPeople"]
    rows += [(520 + k, f"see {x} there", "en") for k, x in enumerate(plain)]
    texts = {i: t for i, t, _ in rows}
    got = digest(scan(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for x in got:
        want = brute_spans(texts[x.doc_id] or "")
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in x.spans.split(",") if s and not s.startswith("random")] == [s for s in want.split(",") if s]
        if (x.doc_id or 0) in (500, 501, 502):
            assert x.spans == f"random:4:{4 + len(keys[x.doc_id - 500])}"
        if (x.doc_id or 0) >= 520:
            assert x.spans == "", plain[x.doc_id - 520]
    odd = docs(spark, rows).withColumns({"spans": F.lit("s"), "row": F.lit(7), "tested": F.col("doc_id")})
    clean = {x.doc_id: x for x in redact(odd).collect()}
    assert clean[500].text == "see [random] there" and clean[521].text == texts[521] and clean[1].text is None and clean[5].text == texts[5]
    assert all((x.spans, x.row, x.tested) == ("s", 7, x.doc_id) for x in clean.values()) and redact(odd).columns == odd.columns
    assert digest(scan(docs(spark, []))).count() == 0 and scan(odd).columns[-2:] == ["base_spans", "spans"]


def brute_battery(token, kind):
    """The five p-values by plain arithmetic."""
    from oddsmill.llm.secrets import ALPHABETS, BINS, STRUCTURED

    text = token.lower() if kind == "hex" else token.replace("-", "+").replace("_", "/")
    v = [ALPHABETS[kind].index(c) for c in text.rstrip("=") if c in ALPHABETS[kind]]
    n, size = len(v), len(ALPHABETS[kind])
    observed = [sum(ALPHABETS[kind][x] in b for x in v) for b in BINS[kind]]

    def chi(shares):
        x = sum((o - n * e) ** 2 / (n * e) for o, e in zip(observed, shares, strict=True))
        return math.exp(-x / 2) * (1 + x / 2)

    up = [2 * x >= size for x in v]
    turns, high = 1 + sum(a != b for a, b in zip(up, up[1:], strict=False)), sum(up)
    mean = 1 + 2 * high * (n - high) / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    two = lambda z: math.erfc(abs(z) / math.sqrt(2))
    runs = two((turns - mean) / math.sqrt(spread)) if spread > 0 else 1e-9
    m = sum(v) / n
    power = sum((x - m) ** 2 for x in v)
    serial = two(sum((a - m) * (b - m) for a, b in zip(v, v[1:], strict=False)) / power * math.sqrt(n)) if power else 1e-9
    uniform = chi([len(b) / size for b in BINS[kind]])
    x = -2 * sum(math.log(max(1e-300, p)) for p in (uniform, runs, serial))
    return [uniform, runs, serial, math.exp(-x / 2) * (1 + x / 2 + x * x / 8), max(map(chi, STRUCTURED[kind]))]


def test_the_battery_equals_plain_arithmetic(spark):
    from oddsmill.llm.secrets import ALPHABETS, BINS, STRUCTURED, battery

    assert all(sorted("".join(BINS[k])) == sorted(a) for k, a in ALPHABETS.items()) and all(abs(sum(x) - 1) < 1e-9 for v in STRUCTURED.values() for x in v)
    r = random.Random(9)
    rows = [(k, "".join(r.choice(a if r.random() < 0.7 else a[: r.randrange(1, 5)]) for _ in range(r.choice([20, 31, 64, 200])))) for k, a in ALPHABETS.items() for _ in range(20)]
    rows += [("hex", "0" * 40), ("hex", "ABCDEF0123" * 3), ("base64", "ab-_" * 8 + "=="), ("base32", "A2" * 30 + "=")]
    for x in spark.createDataFrame(rows, "kind string, token string").withColumn("p", battery(F.col("token"), F.col("kind"))).collect():
        assert [*x.p] == pytest.approx(brute_battery(x.token, x.kind), rel=1e-5, abs=1e-290), (x.kind, x.token)


def test_discoveries_are_those_of_the_stepwise_rule(spark):
    """Benjamini and Hochberg by ranks: random keys come out, and of the structured tokens no more than the rate allows."""
    from oddsmill.llm.secrets import scan

    r = random.Random(15)
    words = [w.capitalize() for w in prose(r, 3000).split()]
    tokens = [("k", "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randrange(24, 60)))) for _ in range(60)]
    while len(tokens) < 360:
        t = "".join(r.choice(words) for _ in range(8))[: r.randrange(24, 60)] + str(r.randrange(100))
        tokens.append(("w", t))
    got = {x.doc_id: [s.kind for s in x.spans if s.kind == 3] for x in scan(docs(spark, [(k, f"a {t} b", "en") for k, (_, t) in enumerate(tokens)])).collect()}
    keys, others = [bool(got[k]) for k in range(60)], [bool(got[k]) for k in range(60, 360)]
    assert sum(keys) >= 57 and sum(others) <= 0.05 * (sum(keys) + sum(others)) + 1


# -- chat -----------------------------------------------------------------------------------------


def test_reply_trees_and_round_trip(spark):
    from oddsmill.llm.chat import format_paths, read_turns, root_to_leaf_paths

    odd = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|", "<|im_end|>\n", "", None, "é😀\n", "100% <b>"]
    m = [("t", 1, None, 0.5, "us\ner%0A<", odd[0]), ("t", 2, 1, 1.0, "assistant", odd[1]), ("t", 3, 1, 2.0, "assistant", odd[2]), ("t", 4, 2, 3.0, None, odd[3]), ("t", 5, 2, None, "user", odd[4]), ("t", 6, 3, 1.0, "user", odd[5])]
    m += [("u", 1, 9, 1.0, "assistant", odd[6]), ("c", 1, 2, 1.0, "user", "x"), ("c", 2, 1, 1.0, "user", "y"), (None, 1, None, 1.0, "user", "z")]
    m += [("long", k, k - 1 if k else None, 0.0, ("user", "assistant")[k % 2], odd[k % 9]) for k in range(70)]
    df = spark.createDataFrame(m, "tree string, node long, parent long, score double, role string, text string")
    paths = root_to_leaf_paths(df, branches=None)
    found = {}
    for p in paths.collect():
        found.setdefault((p.tree, p.leaf), []).append((p.depth, p.node))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {("t", 4): [1, 2, 4], ("t", 5): [1, 2, 5], ("t", 6): [1, 3, 6], ("u", 1): [1], ("long", 69): list(range(70))}
    best = root_to_leaf_paths(df).where("tree = 't'").select("leaf").distinct().collect()
    assert [x.leaf for x in best] == [4]
    by = {(t, n): (role or "", text or "") for t, n, _, _, role, text in m}
    for x in format_paths(df, paths).withColumn("turns", read_turns(F.col("formatted"), F.col("loss"))).collect():
        want = [by[x.tree, n] for _, n in sorted(found[x.tree, x.leaf])]
        assert [(t.role, t.text) for t in x.turns] == want
        assert [t.learnt for t in x.turns] == [text if role == "assistant" else "" for role, text in want]
    assert root_to_leaf_paths(df.limit(0)).count() == 0


def test_conversations_without_an_id_are_one(spark):
    from oddsmill.llm.chat import as_messages, digest, format_paths, root_to_leaf_paths

    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b <|"), (7, None, "assistant", None), (7, 1, None, "\\<|"), (7, 1, None, "\\<|")]
    m = as_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x.conv_id: x for x in digest(format_paths(m, root_to_leaf_paths(m))).collect()}
    assert {k: (x.n_turns, x.loss_chars) for k, x in got.items()} == {None: (2, 4), 7: (3, 0)}
    assert got[None].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb <|\n").hexdigest() and got[None].loss_sha256 == hashlib.sha256(b"b <|").hexdigest()


# -- language, model, pages -----------------------------------------------------------------------


def test_language_is_learnt_from_text_alone(spark):
    from oddsmill.llm.language import fit, identify

    r = random.Random(7)
    train = [(i, prose(r, 60, i % 2), ("en", "de")[i % 2]) for i in range(80)]
    test = [(i, prose(r, 40, i % 2), ("en", "de")[i % 2]) for i in range(200, 260)]
    clashing = docs(spark, train + [(900, None, "en"), (901, "123", "de"), (902, "text", None)]).withColumns({c: F.lit(1) for c in ("share", "h", "k")})
    model = fit(clashing, per_lang=30)
    got = {x.doc_id: x for x in identify(docs(spark, test + ODD + [(700, "12 34", "en")]), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 58
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 700)) and all(0 <= x.score <= 1 for x in got.values())
    assert identify(docs(spark, []), model).count() == 0
    assert {x.lang_pred for x in identify(docs(spark, test), fit(docs(spark, []))).collect()} == {"und"}


def plain_model(train, classes, frequent, endings, in_memory, rounds):
    """The class model by plain counting: context of each symbol, class and count of each word, and the pairs of both."""
    from oddsmill.llm.class_model import END, Symbols, exchange, half_of

    texts = [[*WORD.findall((t or "").encode().lower().decode()), END.decode()] for t in train]
    counts = Counter(w.encode() for t in texts for w in t)
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    for n in sorted({c for _, c in top}):  # whole groups of alike counts
        if sum(c >= n for _, c in top) <= in_memory:
            top = [x for x in top if x[1] >= n]
            break
    else:
        top = []
    symbols = Symbols({w: i for i, w in enumerate({END: 0} | {w: 0 for w, _ in top[:frequent]})}, endings)
    n = np.zeros((len(symbols), len(symbols)))
    for t in texts:
        ids = symbols.of([w.encode() for w in t])
        for a, b in zip([symbols.words[END], *ids[:-1]], ids, strict=True):
            n[a, b] += 1
    context = exchange(n, classes)
    left = {}
    for t in texts:
        g = context[symbols.of([END, *[w.encode() for w in t[:-1]]])]
        for w, c in zip(t, g.tolist(), strict=True):
            left.setdefault(w.encode(), Counter())[c] += 1
    of = {w: int(context[symbols.of([w])[0]]) for w in counts}
    h = lambda x: x * math.log(x) if x > 1 else 0.0

    def pairs():
        out = np.zeros((classes, classes))
        for w, gs in left.items():
            for g, m in gs.items():
                out[g, of[w]] += m
        return out

    def likelihood(p):
        return sum(map(h, p.reshape(-1))) - sum(map(h, p.sum(0)))

    likelihoods = [likelihood(pairs())]
    for k in range(rounds):
        p, moved = pairs(), {}
        for w, gs in left.items():
            c, total = of[w], sum(gs.values())
            rest, sums = p.copy(), p.sum(0)
            for g, m in gs.items():
                rest[g, c] -= m
            sums[c] -= total
            gain = [sum(h(rest[g, j] + m) - h(rest[g, j]) for g, m in gs.items()) - h(sums[j] + total) + h(sums[j]) for j in range(classes)]
            best = max(range(classes), key=lambda j: (gain[j], -j))
            moved[w] = best if half_of([w])[0] == k % 2 and gain[best] > gain[c] + 1e-9 else c
        of = moved
        likelihoods.append(likelihood(pairs()))
    return symbols, context, counts, of, pairs(), likelihoods


def test_families_come_before_languages(spark):
    """Two families of two languages each: the wrong family costs more than a neighbour within it."""
    from oddsmill.llm.language import fit, identify

    r = random.Random(17)
    parts = {"en": ["the", "ing", "and", "ight"], "de": ["the", "ung", "und", "icht"], "fr": ["que", "eau", "ois", "ment"], "es": ["que", "cion", "osa", "mente"]}
    text = lambda k: " ".join("".join(r.choice(parts[k]) for _ in range(r.randrange(1, 4))) for _ in range(40))
    model = fit(docs(spark, [(i, text(k), k) for i, k in enumerate([*parts] * 40)]), per_lang=40)
    assert model.families == ["germanic", "romance"] and {k: len(v) for k, v in model.pairs.items()} == {"germanic": 1, "romance": 1}
    test = [(i, text(k), k) for i, k in enumerate([*parts] * 30)]
    got = {x.doc_id: x.lang_pred for x in identify(docs(spark, test), model).collect()}
    assert sum(got[i] == k for i, _, k in test) >= 115


def test_class_model_equals_plain_counting(spark):
    from oddsmill.llm.class_model import END, _smoothed_moves, score_documents, tokens_of

    r = random.Random(10)
    rows = ODD + [(i, prose(r, r.randrange(5, 60), i % 2), None) for i in range(20, 90)]
    train = [x for x in rows if x[0] is None or x[0] % 3]
    how = {"classes": 6, "frequent": 20, "endings": 16, "in_memory": 30, "rounds": 4}
    got = score_documents(docs(spark, rows), docs(spark, train), **how).collect()
    symbols, context, counts, of, pairs, likelihoods = plain_model([t for _, t, _ in train], **how)
    assert likelihoods[-1] > likelihoods[0] and len(set(of.values())) > 2
    moves, tokens = _smoothed_moves(pairs), pairs.sum(0)
    norm = np.log10(tokens + 0.5 * (np.bincount([*of.values()], minlength=6) + 1))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for x in got:
        w = [*(texts[x.doc_id] or "").encode().lower().split(), END]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(k in counts for k in w), n)
        assert math.isclose(x.base_score, sum(math.log10((counts[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w), rel_tol=1e-9)
        g = context[symbols.of([END, *w[:-1]])]
        c = [of.get(k, int(context[symbols.of([k])[0]])) for k in w]
        assert math.isclose(x.score, sum(moves[a, b] + math.log10(counts[k] + 0.5) - norm[b] for a, b, k in zip(g, c, w, strict=True)), rel_tol=1e-9)
    seen = [x for x in got if (x.doc_id or 0) >= 20]
    assert sum(x.score for x in seen) > sum(x.base_score for x in seen)
    assert score_documents(docs(spark, []), docs(spark, train), **how).count() == 0
    blank = score_documents(docs(spark, rows), docs(spark, []), **how).collect()
    assert len(blank) == len(rows) and all(x.n_known == 0 and x.train_tokens == 0 and math.isfinite(x.score) for x in blank)
    raw = [(t or "").encode() for _, t, _ in rows]
    codes, starts, distinct = tokens_of(raw)
    assert [[distinct[k] for k in codes[a:b]] for a, b in zip(starts, starts[1:], strict=False)] == [[*t.lower().split(), END] for t in raw]


def test_exchange_never_lowers_the_likelihood():
    from oddsmill.llm.class_model import _plogp, exchange

    r = np.random.default_rng(1)
    n = r.poisson(0.4, (40, 40)) + np.kron(np.eye(2), np.ones((20, 20))).astype(int) * r.poisson(3, (40, 40))

    def likelihood(of):
        one = np.eye(4)[of]
        p = one.T @ n @ one
        return _plogp(p.astype(float)).sum() - _plogp(p.sum(0).astype(float)).sum() - _plogp(p.sum(1).astype(float)).sum()

    scores = [likelihood(exchange(n, 4, sweeps=k)) for k in range(5)]
    assert all(b >= a - 1e-6 for a, b in zip(scores, scores[1:], strict=False)) and scores[-1] > scores[0]


def test_main_text_of_pages(spark):
    from oddsmill.llm.html_text import extract

    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this site</div><div class="ad">Buy now</div><article><h1>A title</h1><p><b>First &amp; <a href="x">linked</a>   text.<br><p>Second.</p>
    <script>var t="</p>";</script><p>Third<br>line</p><p>x &lt; y</p></article><aside>More reading here for you</aside><section id="comments"><p>Great post, I liked it.</p></section>
    <form><p>Search</p></form><footer>&copy; us</footer></body></html>"""
    want = "A title\n\nFirst & linked text.\n\nSecond.\n\nThird line\n\nx < y"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "plain"), (5, "u", "plain")], "page_id long, url string, html string")
    got = sorted((x.page_id, x.text) for x in extract(df).collect())
    assert got == [(1, want), (2, ""), (3, ""), (4, ""), (5, "plain"), (5, "plain")]
    assert extract(df.limit(0)).count() == 0


def test_main_text_keeps_the_short_parts_of_an_article():
    from oddsmill.llm.html_text import main_text

    long = "A long stretch of text that outweighs all others. " * 20
    body = f"""<div class="body"><p>{long}</p><figure><img src="x"><figcaption>Caption</figcaption></figure><div class="ad">Buy now</div><p>Between.</p><section><h2>Short</h2><p>Part.</p></section>
    <aside>Elsewhere</aside><form><p>Search</p></form><div><div><p>The end.</p></div></div></div>"""
    want = ["Title", long.strip(), "Caption", "Between.", "Short", "Part.", "The end."]
    page = "<html><body><nav>Menu</nav>{}<footer>Us</footer></body></html>"
    for around in ("<article><h1>Title</h1>{}</article>", "<main><section><h1>Title</h1></section><article>{}</article></main>"):
        assert main_text(page.format(around.format(body))).split("\n\n") == want
    assert main_text(page.format(f"<div><h1>Title</h1></div><div>{long}</div>")).split("\n\n") == want[:2]
    assert main_text(page.format(f"<p>Hello</p><div class='menu'>Menu</div><article><p>{long}</p></article>")) == long.strip()


def test_windows_surge_and_dive():
    from oddsmill.llm.html_text import WINDOW, surging, window_sums

    r = random.Random(12)
    for _ in range(200):
        n = r.randrange(1, 30)
        w, g = np.array([r.choice([0, 0, 5, 40, 100]) for _ in range(n)]), np.sort([r.randrange(4) for _ in range(n)])
        sums = window_sums(w, g)
        assert sums.tolist() == [sum(int(w[j]) for j in range(i, min(n, i + WINDOW)) if g[j] == g[i]) for i in range(n)]
        kept = surging(w, sums, g, 86).tolist()
        for i in range(n):
            # A line is text if a surge stands before it with no dive between, and it is no linked line at an end.
            before = [a for a in range(i + 1) if g[a] == g[i] and sums[a] >= 86 and w[a] and all(sums[a : i + 1])]
            after = [b for b in range(i, n) if g[b] == g[i] and w[b] and all(sums[i : b + 1])]
            assert kept[i] == bool(before and after)


def test_class_names_are_weighed_word_by_word():
    from oddsmill.llm.html_text import evidence, main_text

    strong = ["ad", "ad-slot-1", "cookie-notice", "siteFooter", "comments", "reader-comments", "navBar", "x sidebar"]
    weak, none = ["legal", "related-posts", "notice"], ["side-effects", "search-engines", "adrenaline", "legal-history", "content", "add", "menuhin"]
    assert [evidence("div", f' class="{c}"', True) for c in strong + weak + none] == ["strong"] * 8 + ["weak"] * 3 + [""] * 7
    assert evidence("p", ' class="legal"', True) == "" and evidence("header", "", True) == "" and evidence("header", "", False) == "strong" and evidence("article", ' class="comment"', True) == "strong"
    text = ["A first paragraph of the text that is as long as most of them are here.", "A second one that says about as much as the first, or a little more.", "And a third one to end with, which is just about as long as the others."]
    p = [f"<p>{x}</p>" for x in text]
    page = "<body><header><h1>Site</h1></header>{}<footer>Us</footer></body>"
    for c in none + ["legal"]:
        assert main_text(page.format(f"<article><header><h1>Title</h1></header><div class='{c}'>{p[0]}{p[1]}</div>{p[2]}</article>")).split("\n\n") == ["Title", *text]
        assert main_text(page.format(f"<div><h1>Title</h1></div><div class='{c}'>{p[0]}{p[1]}</div><div>{p[2]}</div>")).split("\n\n")[-3:] == text
    assert main_text(page.format(f"<article>{''.join(p)}<div class='related'>Read this too</div></article>")).split("\n\n") == text
    assert main_text(page.format(f"<article>{p[0]}<article class='comment'>{p[1]}</article>{p[2]}</article>")).split("\n\n") == [text[0], text[2]]


def test_links_menus_and_forms_without_marks():
    from oddsmill.llm.html_text import main_text

    text = [f"Paragraph {k} of the text, which is long enough to be taken for prose by any rule that looks at lengths." for k in range(4)]
    p = [f"<p>{x}</p>" for x in text]
    linked = f"<p><a href='x'>{text[3]}</a></p>"
    menu = "<div><a href='1'>Home</a></div><div><a href='2'>News</a></div><div><a href='3'>Contact</a></div>"
    assert main_text(f"<body><div>{menu}</div><div>{''.join(p[:3])}{linked}</div><div>{menu}</div></body>").split("\n\n") == text
    assert main_text(f"<body><article>{p[0]}{linked}<p><a href='x'>short</a></p></article></body>").split("\n\n") == [text[0], text[3], "short"]
    assert main_text(f"<body><div>{p[0]}{p[1]}<div class='ad'>Buy</div><p>The end.</p></div><div>{menu}</div></body>").split("\n\n") == [*text[:2], "The end."]
    assert main_text(f"<body><form><div>{''.join(p)}</div><p>Search</p></form></body>").split("\n\n") == [*text, "Search"]
    assert main_text(f"<body><div>{''.join(p)}</div><form><label>Your name</label><p>Send</p></form></body>").split("\n\n") == text
    cards = "".join(f"<article><h2>Card {k}</h2></article>" for k in range(3))
    assert main_text(f"<body><div><h1>Title</h1>{''.join(p)}</div>{cards}</body>").split("\n\n") == ["Title", *text]
