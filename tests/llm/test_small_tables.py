"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import functools
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphmill.llm import decontam, digests, html_text, langid, ngram_join, repeats, token_files, toxicity, url_filter
from glyphmill.llm.common import without
from glyphmill.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(j) for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 50, n), strict=True))


LONG = prose(99, 30_000)
ROWS = [
    (1, prose(1, 60), "en", "x", 7),
    (2, prose(1, 60) + " tail1 tail2", "en", "y", None),
    (3, None, None, None, None),
    (4, "", "de", "z", 0),
    (4, "", "de", "z", 0),
    (5, LONG, "en", "x", 1),
    (6, LONG, "en", "x", 1),
    (7, "one two", "en", "q", 2),
    (8, "one two", "en", "q", 2),
    (None, prose(3, 40), "fr", "n", 3),
    (9, prose(5, 30) + " " + prose(6, 30), "fr", "n", 3),
    (10, prose(7, 30) + " " + prose(6, 30), "fr", "n", 3),
]
SCHEMA = "doc_id long, text string, lang string, score string, starts int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def sets_of(text, n):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(low[i : i + n]) for i in range(len(low) - n + 1)} if len(low) >= n else ({tuple(low)} if low else set())


def brute_components(rows, n, percent):
    group = {i: i for i, *_ in rows}
    own = {i: sets_of(t, n) for i, t, *_ in rows}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in own:
        for b in own:
            if a is not None and b is not None and a < b and own[a] and own[b]:
                shared = len(own[a] & own[b])
                if 100 * shared >= percent * (len(own[a]) + len(own[b]) - shared):
                    x, y = top(a), top(b)
                    group[max(x, y)] = min(x, y)
    return {i: (len(own[i]), top(i)) for i in own}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_join_components(docs, n, percent):
    got = ngram_join.join_components(docs, n=n, percent=percent).collect()
    want = brute_components(ROWS, n, percent)
    assert len(got) == len(ROWS)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_join_of_many_near_copies(spark):
    rng = np.random.default_rng(4)
    base = prose(11, 120).split()
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 5)):
            words[at] = f"edit{rng.integers(0, 6)}"
        rows.append((i, " ".join(words)))
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85)
    want = brute_components(rows, 4, 85)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got.collect())


def overlapping_sets(seed, clusters):
    """Texts of distinct words: pairs with more than 0.8 of their words in common among others that share some of them."""
    rng = np.random.default_rng(seed)
    weights = 1 / (5 + np.arange(1500))
    rows = []
    for _ in range(clusters):
        words = rng.choice(1500, rng.integers(8, 60), replace=False, p=weights / weights.sum())
        rows.append(words)
        rows.append(words[: len(words) - int(rng.integers(0, len(words) // 6 + 1))])
        rows.append(np.concatenate([words[: len(words) * 2 // 3], 2000 + rng.choice(1500, len(words) // 3, replace=False)]))
    return [(i, " ".join(f"w{w}" for w in words)) for i, words in enumerate(rows)]


def brute_links(rows, n, percent):
    lead = {}
    for i, t in rows:
        lead.setdefault(frozenset(sets_of(t, n)), i)
    own = [(i, s) for s, i in lead.items()]
    return {(a, b) for a, x in own for b, y in own if a < b and 100 * len(x & y) >= percent * len(x | y)}


@pytest.mark.parametrize("percent", [80, 85])
def test_join_meets_pairs_of_different_levels(spark, monkeypatch, percent):
    monkeypatch.setattr(ngram_join, "FIRST", 0)  # no links by least hashes: all of them come from the prefixes
    rows = overlapping_sets(7, 400)
    links = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), n=1, percent=percent)[2]
    assert {(r.a, r.b) for r in links.collect()} == brute_links(rows, 1, percent)


def test_all_links_within_groups(spark):
    base = prose(12, 100).split()
    rows = [(i, " ".join(w if k != 9 * i else f"own{i}" for k, w in enumerate(base))) for i in range(6)] + [(9, prose(13, 50)), (10, prose(13, 50))]
    got = {(r.a, r.b) for r in ngram_join.all_links(spark.createDataFrame(rows, "doc_id long, text string"), n=1, percent=85).collect()}
    assert got == brute_links(rows, 1, 85) == {(a, b) for a in range(6) for b in range(a + 1, 6)}


def test_candidates_of_a_document_with_fewer_shared_ngrams_than_its_level(spark):
    rows = [(1, 1, 18, 2, [1, 2, 3, 4, 5], [2] * 5, list(range(1, 19))), (2, 2, 15, 1, [5, 16, 17, 18], [2] * 4, list(range(4, 19)))]
    prefix = spark.createDataFrame(rows, ngram_join._PREFIXES)
    assert [(r.a, r.b) for r in ngram_join.candidates(prefix, 80, 2).collect()] == [(1, 2)]


@pytest.mark.parametrize(("block", "long_list"), [(8, 4), (8, 10**9), (1024, 4)])
def test_join_of_split_and_checked_lists(spark, monkeypatch, block, long_list):
    monkeypatch.setattr(ngram_join, "FIRST", 0)
    rows = overlapping_sets(9, 120)
    links = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), n=1, percent=80, block=block, long_list=long_list)[2]
    assert {(r.a, r.b) for r in links.collect()} == brute_links(rows, 1, 80)


def test_pairs_are_the_same_by_slices(monkeypatch):
    rng = np.random.default_rng(6)
    lists = [np.unique(rng.integers(0, 400, 60)) for _ in range(90)]
    other = [np.arange(90), np.arange(90), np.full(90, 60), rng.integers(4, 12, 90), np.full(90, -1)]
    whole = ngram_join._pairs(lists, *other, 80)
    monkeypatch.setattr(ngram_join, "CELLS", 1)
    assert whole and ngram_join._pairs(lists, *other, 80) == whole


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_keeps_one_of_each_with_all_columns(docs):
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [1, 3, 4, 4, 5, 7, 9, 10]


@pytest.mark.parametrize("most", [0, 10])
def test_rows_without_ids_are_the_same_by_broadcast_and_by_shuffle(docs, most):
    gone = docs.where("doc_id is null or doc_id in (4, 7)").select("doc_id")
    got = without(docs, "doc_id", gone, "test-gone", most)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3, 5, 6, 8, 9, 10]
    assert without(docs, "doc_id", gone.limit(0), "test-gone", most).count() == len(ROWS)


def test_prefix_choice_prefers_cheap_levels():
    tokens, times = np.arange(40), np.repeat([2, 500], 20)
    level, some, _ = ngram_join.choose_prefix(tokens, times, 40, 80)
    assert 1 <= level <= 8 and len(some) == 40 - 32 + level


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t, *_ in sorted({(r[0] if r[0] is not None else -1, r[1] or "") for r in rows}):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            else:
                seen.add(b[k : k + length])
        out[i] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats(docs):
    want = brute_repeats(ROWS, 100)
    got = repeats.repeats(docs).collect()
    assert len(got) == len(ROWS)
    assert all((r.n_bytes, r.n_removed, r.kept_sha256) == want[-1 if r.doc_id is None else r.doc_id] for r in got)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_repeats_are_the_same_by_broadcast_and_by_shuffle(docs, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_BROADCAST", most)
    want = brute_repeats(ROWS, 100)
    got = repeats.repeats(docs)
    assert ("strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()) == (most > 0)
    assert all((r.n_bytes, r.n_removed, r.kept_sha256) == want[-1 if r.doc_id is None else r.doc_id] for r in got.collect())


def test_repeats_within_a_text_and_periods(spark):
    rows = [(1, "ab" * 300), (2, "x" * 250 + "ab" * 60), (3, "é" * 120 + "ab" * 55), (4, "ba" * 200)]
    want = brute_repeats(rows, 100)
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r.n_bytes, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)


@pytest.mark.parametrize(("hot", "held"), [(2, 100_000), (9, 100_000), (2, 5)])
def test_repeats_around_hot_anchors(spark, monkeypatch, hot, held):
    """A line that all documents hold, in contexts that are partly the same; its strings are dealt in ranges, down to one each."""
    monkeypatch.setattr(repeats, "HELD", held)
    line = prose(41, 22)
    rows = [(i, prose(50 + i % 7, 9) + " " + line + " " + prose(80 + i % 5, 9) + (line[:60] + line if i % 4 == 0 else "")) for i in range(40)]
    rows += [(40, line), (41, line[3:]), (42, line[:130] + "!" + line[20:]), (42, line[:130] + "!" + line[20:]), (43, None), (44, line[:99])]
    want = brute_repeats(rows, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    counted = repeats.repeated_anchors(df.selectExpr("doc_id", "md5(text) AS mark", "coalesce(text, '') AS text").where("text <> ''"), 100, 32, 3, hot)
    dealt = {a & 0xFFFF for r in counted.collect() for a in r.anchors}
    assert max(dealt) > 1
    got = repeats.repeats(df, hot=hot).collect()
    assert len(got) == len(rows) and all((r.n_bytes, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)


def test_anchors_are_the_same_by_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    text = rng.integers(97, 101, 20_000).astype(np.uint8)
    text[9_000:13_000] = text[2_000:6_000]
    ends = np.sort(np.append(rng.choice(20_000, 30, replace=False), 20_000))
    whole = repeats.anchors(text, ends, 100, 32)
    for block in (1, 97, 4_096):
        monkeypatch.setattr(repeats, "BLOCK", block)
        assert all(np.array_equal(a, b) for a, b in zip(whole, repeats.anchors(text, ends, 100, 32), strict=True))


def test_pieces_of_a_hot_anchor_hold_each_string_once_and_equal_strings_share_keys():
    rng = np.random.default_rng(5)
    body = rng.integers(97, 123, 300).astype(np.uint8)
    text = np.concatenate([body, rng.integers(97, 123, 50).astype(np.uint8), body])
    place, first, last, hashes = repeats.anchors(text, np.array([len(text)]), 100, 32)
    whole = {i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)}
    for ranges in (1, 2, 3, 5, 34, 68, 69):
        which, low, high, key = repeats.pieces_of(text, place, first, last, hashes, np.full(len(place), ranges), 100, 32)
        keys = {i: k for a, b, k in zip(low, high, key, strict=True) for i in range(a, b + 1)}
        assert sum(b - a + 1 for a, b in zip(low, high, strict=True)) == len(whole) and keys.keys() == whole
        assert all(keys[i] == keys[i + 350] for i in range(201))
        assert (high - low < -(-69 // ranges)).all()


def test_texts_without_repeats_keep_columns(docs):
    got = repeats.without_repeats(docs, chars=None)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert 6 not in rows and rows[5].text == LONG and rows[1].text == ROWS[0][1] and rows[3].text is None


def plain_digest(text):
    """Length code, then the quartile codes of hashed byte triplets, one by one."""
    import math

    data, counts = text.encode(), [0] * 256
    for i in range(len(data)):
        for number, (j, k) in enumerate([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]):
            if i + k < len(data):
                mixed = ((data[i] * 40503 + data[i + j] * 25931) ^ (data[i + k] * 60493 + number * 7919)) % 65536
                counts[(mixed * 40503 % 65536) >> 8] += 1
    quartiles = [sorted(counts)[k] for k in (63, 127, 191)]
    return min(255, round(4 * math.log2(len(data) + 1))), [sum(c > q for q in quartiles) for c in counts]


def plain_likeness(a, b):
    cost = [0, 1, 2, 6]
    usual = 256 * sum(cost[abs(x - y)] for x in range(4) for y in range(4)) / 16 + 12
    return max(0.0, 1 - (sum(cost[abs(x - y)] for x, y in zip(a[1], b[1], strict=True)) + min(12, abs(a[0] - b[0]))) / usual)


def test_digests(spark, docs):
    rows = sorted(digests.fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    ordered = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda r: (r[0] is not None, r[0], r[1]))
    assert [r.doc_id for r in rows] == [i for i, _ in ordered]
    digest = functools.cache(plain_digest)
    shown = lambda d: f"{d[0]:02x}" + "".join(f"{d[1][k] << 6 | d[1][k + 1] << 4 | d[1][k + 2] << 2 | d[1][k + 3]:02x}" for k in range(0, 256, 4))
    for k, (r, (_, text)) in enumerate(zip(rows, ordered, strict=True)):
        following = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        assert (r.fingerprint, r.edited_fingerprint) == (shown(digest(text)), shown(digest(edited)))
        assert r.near_edited == pytest.approx(plain_likeness(digest(text), digest(edited))) and r.near_next == pytest.approx(plain_likeness(digest(text), digest(following)))
    one = digests.fingerprints(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_digest_counts_by_hand():
    data = bytes(range(40))
    assert digests.counts(data).sum() == sum(40 - j for _, j in digests.TRIPLETS)
    assert digests.difference(digests.digest(data), digests.digest(data)) == 0


def test_digest_counts_all_triplets_of_a_window():
    for size in (2, 3, 4, 5, 30):
        want = sum(1 for i in range(size) for j in range(i + 1, min(i + 5, size)) for k in range(j + 1, min(i + 5, size)))
        assert digests.counts(bytes(range(size))).sum() == want


def test_token_files(docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(docs, path, str(tmp_path), sequence=64, batch_sequences=4, parts=3)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(path)
    start = 0
    for r in got:
        texts = [t or "" for i, t, *_ in ROWS if i == r.doc_id]
        crcs = {zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts}
        assert r.start == start and r.ids_crc32 in crcs
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted([i for i, *_ in ROWS], key=lambda i: (i is not None, i))
    shard = token_files.TokenShard(manifest.first().file)
    ids, mask = shard.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(TOKENIZER, "uint16")


@pytest.mark.parametrize("text", ["It's  a TEST,\nof don't!", "x\x1cy z\x85w", "<|endoftext|> a", "<|ENDOFTEXT|> B", "naïve É́a", "ÀB. c9d", "\u0130.", "\u0958.", "e\u0301, e\u0301.x", "'S 'll'x 12'd ''re", "a\u00a0b\u3000c", "1\u20e3 <\u0338 =\u0338", " ", "\u1100\u1161."])
def test_runs_encode_as_the_library_does(encoder, text):
    assert encoder.by_runs
    assert encoder.encode(text).tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_every_letter_encodes_as_the_library_does_beside_signs_digits_and_marks(encoder):
    library = Tokenizer.from_file(TOKENIZER)
    texts = []
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha() and (code < 0x3000 or code % 97 == 0):
            texts += [f"{c}. x{c}, {c}9 .{c} {c}\u0301! '{c}"]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    for low in range(0, len(texts), 500):
        got = [i.tolist() for i in encoder.encode_many(texts[low : low + 500])]
        assert got == want[low : low + 500]


def test_another_tokenizer_file_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = token_files.Encoder(path, "uint16")
    assert not other.by_runs
    assert other.encode("Hello  World, it's").tolist() == Tokenizer.from_file(path).encode("Hello  World, it's", add_special_tokens=False).ids


def test_language_id(docs, spark):
    english, german = "the cat and the dog of that house with them", "der hund und die katze mit dem haus nicht das"
    train = spark.createDataFrame([(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string")
    model = langid.learn(train)
    assert model.langs == ["de", "en"]
    assert model.predict("the dogs of them")[0] == "en" and model.predict("hunde und katzen")[0] == "de"
    assert model.predict(None) == model.predict("12 !") == model.predict("½ ² Ⅷ") == model.predict("\u0301 ١") == ("und", 0.0)
    assert model.predict("katzenhaus")[0] == "de"  # unseen: by characters
    got = langid.recognized(docs, model)
    assert got.columns == docs.columns
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.learn(train.limit(0)).predict("a") == ("und", 0.0)
    clash = langid.identify(docs, model)  # the input's own column score gives way
    assert clash.columns == ["doc_id", "text", "lang", "starts", "lang_pred", "score"] and clash.select("score").count() == len(ROWS)


def _plain_language(train, text, longest=4, floor=0.5):
    """Word-first backoff by dictionaries: log frequencies of words, else the mean of the longest known n-grams."""
    import math
    import unicodedata
    from collections import Counter

    def words(t):
        out, now = [], ""
        for c in t.lower() + " ":
            if unicodedata.category(c)[0] in "LM":
                now += c
            else:
                out += [now] if any(unicodedata.category(x)[0] == "L" for x in now) else []
                now = ""
        return out

    langs = sorted({lang for _, lang in train})
    count = {lang: Counter(w for t, x in train if x == lang for w in words(t)) for lang in langs}
    grams = {lang: [Counter(f" {w} "[i : i + n] for w in count[lang] for i in range(len(w) + 3 - n)) for n in range(1, longest + 1)] for lang in langs}
    kinds = len(set().union(*count.values()))
    gram_kinds = [len(set().union(*(grams[lang][n] for lang in langs))) for n in range(longest)]
    log = lambda c, key, k: math.log(c[key] + floor) - math.log(sum(c.values()) + floor * k)
    total = dict.fromkeys(langs, 0.0)
    seen = words(text)
    for w in seen:
        if any(w in count[lang] for lang in langs):
            for lang in langs:
                total[lang] += log(count[lang], w, kinds)
            continue
        marked = f" {w} "
        for end in range(2, len(marked) + 1):
            n = next((n for n in range(min(longest, end), 0, -1) if any(marked[end - n : end] in grams[lang][n - 1] for lang in langs)), 0)
            for lang in langs if n else ():
                total[lang] += log(grams[lang][n - 1], marked[end - n : end], gram_kinds[n - 1]) / (len(marked) - 1)
    if not seen:
        return "und", 0.0
    z = np.array([total[lang] for lang in langs]) / len(seen) * min(len(seen), 30)
    p = np.exp(z - z.max())
    p /= p.sum()
    return langs[int(p.argmax())], float(p.max())


def test_languages_equal_a_plain_version(spark):
    train = [(prose(i, 12).replace("a", "ä" if i % 3 == 0 else "a").replace("o", "о́" if i % 3 == 1 else "o"), "xyz"[i % 3]) for i in range(30)]
    rows = [(i * 5 + 1, t, x) for i, (t, x) in enumerate(train)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    used = [(t, x) for _, t, x in rows]
    for text in ["alpha1 bèta quux", "о́micr о́о́ zzzz", "\u0301a ½b c", "Sigma TAU rho12", "нов \u0915\u093f\u0924\u093e\u092c", "q", "12"]:
        want = _plain_language(used, text)
        got = model.predict(text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-4)
    texts = [t for t, _ in used] + [None, ""]
    together = model.predict_many(texts)
    assert [model.predict(t)[0] for t in texts] == together[0]


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        words = prose(1000 + i, 40).split()
        for at in rng.integers(0, 40, 4 if bad else 0):
            words[at] = ("idiot", "st*pid", "loser!", "grobelix")[rng.integers(0, 4)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.0}


@pytest.mark.parametrize("token", ["idi" + "o" * 60 + "t", "i" + "." * 50 + "d.i.o.t", "-".join("l" * 30 + "o" * 30 + "s" * 30 + "er")])
def test_stretched_and_dotted_insults_are_hidden_hits(token):
    assert toxicity.word_class(token) & toxicity.HIDDEN
    assert not toxicity.word_class("a" * 60) & toxicity.HIDDEN


def test_toxicity_features_of_a_text():
    reader = toxicity.Reader({"grob*": 3.0})
    got = dict(zip(toxicity.FEATURES, reader.features("YOU are an idiot, st*pid grobian! Why? OK i.d.i.o.t"), strict=True))
    assert got["hits_log"] == pytest.approx(np.log(4)) and got["hit_share"] == pytest.approx(3 / 9) and got["distinct_hits"] == 3
    assert got["hidden_share"] == pytest.approx(2 / 9) and got["hits_near_you"] == pytest.approx(2 / 3) and got["you_share"] == pytest.approx(1 / 9)
    assert got["shouted"] == pytest.approx(1 / 9) and got["exclamations"] == pytest.approx(1 / 51) and got["questions"] == pytest.approx(1 / 51)
    assert got["capitals"] == pytest.approx(6 / 35) and got["learned_share"] == pytest.approx(1 / 9) and got["learned_weight"] == pytest.approx(3 / 9)
    assert toxicity.Reader({}).features(None) == toxicity.Reader({}).features("") == [0.0] * len(toxicity.FEATURES)


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(0)
    x = np.round(rng.random((120, 3)), 1)
    y = ((x[:, 1] > 0.4) ^ (rng.random(120) < 0.1)).astype(int)
    tree = toxicity.Boosted(trees=1, depth=1, bins=20, least=5).fit(x, y)
    p = y.mean()
    grad, hess = y - p, np.full(120, p * (1 - p))
    gain = lambda j, c: sum(grad[s].sum() ** 2 / (hess[s].sum() + 1) for s in (x[:, j] <= c, x[:, j] > c))
    all_ = [(gain(j, c), j, c) for j in range(3) for c in np.unique(x[:, j]) if 5 <= (x[:, j] <= c).sum() <= 115]
    feature, cut, value = tree.nodes[0]
    assert gain(feature[0], cut[0]) == pytest.approx(max(all_)[0])
    raw = tree.raw(x)
    assert raw == pytest.approx(tree.base + np.where(x[:, feature[0]] > cut[0], value[1], value[0]))


def test_isotonic_equals_the_least_squares_rising_fit():
    rng = np.random.default_rng(1)
    score, y = np.sort(rng.random(12)), rng.integers(0, 2, 12)
    x, level = toxicity.isotonic(score, y)
    fit = [max(min(np.mean(y[a : b + 1]) for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]  # max-min formula
    assert sorted(set(np.round(fit, 9))) == sorted(set(np.round(level, 9)))


def test_isotonic_is_rising():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()


def test_decontamination(spark):
    item = prose(21, 40)
    edited = item.split()
    edited[5] = edited[17] = edited[30] = "changed"
    docs = spark.createDataFrame([(1, prose(30, 200) + " " + item + " " + prose(31, 50), "a"), (2, prose(32, 80) + " " + " ".join(edited).upper(), "b"), (3, prose(33, 300), "c"), (4, None, None), (5, "", "d"), (1, item, "e")], "doc_id long, text string, score string")
    items = spark.createDataFrame([(7, item), (8, prose(40, 30)), (9, None), (10, ""), (11, "unheard")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7].score == 1.0 and 0.7 < got[2, 7].score < 1
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [3, 4, 5]
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), items).count() == 0


def test_decontamination_finds_edited_copies_whose_item_has_many_other_grams(spark):
    items, docs = [], []
    for k, (size, every) in enumerate([(50, 6), (80, 8), (120, 10)]):
        item = [f"w{k}x{i}" for i in range(size)]
        copy = [f"new{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
        items.append((k, " ".join(item)))
        docs.append((k, prose(50 + k, 60) + " " + " ".join(copy) + " " + prose(60 + k, 60)))
        docs += [(100 * (k + 1) + j, " ".join(item[j : j + 4])) for j in range(5)]  # the copy's n-grams are not the rarest
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2)} and all(0.7 < v < 0.9 for v in got.values())


def test_decontamination_in_groups_of_items_and_recall_of_edited_copies(spark):
    """Nine of ten copies or more are found with a fifth of the words replaced, lost or added; groups of items change nothing."""
    rng = np.random.default_rng(8)
    items, docs = [], []
    for k in range(60):
        item = prose(5000 + k, int(rng.integers(25, 90))).split()
        copy = []
        for w in item:
            edit = rng.random()
            copy += [] if edit < 0.05 else ["new"] if edit < 0.15 else [w, "more"] if edit < 0.2 else [w]
        items.append((k, " ".join(item)))
        docs.append((k, prose(6000 + k, 80) + " " + " ".join(copy) + " " + prose(7000 + k, 80)))
    docs += [(1000 + k, prose(8000 + k, 200)) for k in range(60)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in decontam.contaminated(left, right).collect()}
    assert sum((k, k) in {r[:2] for r in one} for k in range(60)) >= 54 and all(r[0] < 1000 for r in one)
    assert {tuple(r) for r in decontam.contaminated(left, right, most_chars=4_000).collect()} == one


def test_places_equal_an_alignment_with_the_whole_text(spark):
    """Seeds and windows lose nothing: each score is that of the item's alignment with all words of the text."""
    rng = np.random.default_rng(3)
    items = [(k, prose(9000 + k, 30)) for k in range(4)]
    docs = []
    for k in range(40):
        words = prose(9100 + k, 60).split()
        item = items[k % 4][1].split()
        low = int(rng.integers(0, 8))
        words[20:20] = [w if rng.random() > 0.15 else "other" for w in item[low:]]
        docs.append((k, " ".join(words)))
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            score = brute_alignment(item.split(), text.split()) / (2 * len(item.split()))
            if score >= decontam.THRESHOLD:
                want[d, i] = score
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 25


@pytest.mark.parametrize("every", [2, 3, 4, 7])
def test_evenly_edited_copies_above_the_threshold_are_all_found(spark, every):
    """Every second to seventh word replaced, lost or followed by another one, in texts of the items' own common words."""
    rng = np.random.default_rng(every)
    items, docs = [], []
    for k in range(40):
        item = prose(300 + k, int(rng.integers(16, 60))).split()
        kind = k % 3
        copy = []
        for i, w in enumerate(item):
            turn = i % every == every - 1
            copy += ["new"] if turn and kind == 0 else [] if turn and kind == 1 else [w, "more"] if turn else [w]
        items.append((k, " ".join(item)))
        docs.append((k, prose(400 + k, 70) + " " + " ".join(copy) + " " + prose(500 + k, 70)))
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, item in (x for x in items if x[0] == d or (d, x[0]) in got):
            score = brute_alignment(item.split(), text.split()) / (2 * len(item.split()))
            if score >= decontam.THRESHOLD:
                want[d, i] = score
    assert got == pytest.approx(want) and len(want) >= (13 if every == 2 else 39)


def test_words_of_plain_texts_are_those_of_the_pattern():
    for text in ("It's A_b 12,x-Y\tz\n\x00q", "", "___", "Éa ½x_ß×ÿ", "İx", "".join(map(chr, range(300))), "".join(map(chr, range(256)))):
        assert [w.decode("latin-1") if isinstance(w, bytes) else w for w in decontam.words_of(text)] == decontam.WORD.findall(text.lower())


def test_short_items_need_six_words_or_all(spark):
    items = [(1, "one two three"), (2, "aa bb cc dd ee ff gg hh"), (3, "x")]
    docs = [(1, "zero one two three four"), (2, "one two thre"), (3, "q aa bb cc dd ee ff q"), (4, "q aa bb cc dd ee q"), (5, "x"), (6, "xx y")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (5, 3)}


def test_seeds_are_the_rarest_words_of_all_documents(spark):
    book = decontam.Items([(1, "a b c d e f g h i j k l")])
    docs = spark.createDataFrame([(i, " ".join("abcdefghijkl"[: i % 13]) + " A") for i in range(60)], "doc_id long, text string")
    counts = decontam.document_counts(docs, book.words, book.size)
    assert counts.tolist() == [60] + [sum(i % 13 >= k for i in range(60)) for k in range(2, 13)]
    book.ranked(counts)
    assert [w for w in range(12) if book.first[w + 1] > book.first[w]] == list(range(3, 12))


def brute_alignment(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if x == y else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def test_alignment_scores():
    rng = np.random.default_rng(2)
    item = rng.integers(0, 6, 14)
    windows = [rng.integers(0, 6, n) for n in (3, 20, 40)]
    assert [round(s * 2 * len(item)) for s, _, _ in decontam.align(item, windows)] == [brute_alignment(item, w) for w in windows]


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "http://EXAMPLE.com/de/2?x#y", "https://b.org/fr/3", "http://x.net/de/", "http://x.net", "no scheme", None, "http://good.example.org/en/5", "ftp://fooexample.net/en/q", "http://z.com?q/", "http://z.com?q/"]
    rows = {(r.page_id): r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(9)] == [("a.example.net", "/en/1", "example.net/en/"), ("example.com", "/de/2", "example.com/de/"), ("b.org", "/fr/3", "org/fr/"), ("x.net", "/de/", "net/"), ("x.net", "", None), ("", "", None), ("", "", None), ("good.example.org", "/en/5", None), ("fooexample.net", "/en/q", "net/")]
    assert [rows[i].verdict for i in (0, 1, 2, 3)] == ["allow", "block", "allow", "block"]
    assert len(rows) == len(urls) and all(r.verdict in ("allow", "block") for r in rows.values())
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def random_urls(seed, count, length):
    letters = np.random.default_rng(seed).integers(97, 123, (count, length), dtype=np.uint8)
    return [f"{bytes(x).decode()}.{('example.net/en/', 'net/', 'org/fr/', 'org/')[k % 4]}{k % 7}" for k, x in enumerate(letters)]


def test_url_models_keep_all_grams(spark):
    bodies = random_urls(1, 30_000, 20)
    rows = spark.createDataFrame([(b, k % 2 == 0) for k, b in enumerate(bodies)], "body string, good boolean")
    padded = ["\1" * url_filter.ORDER + b + "\2" for b in bodies]
    want = {p[at - k : at + 1] for p in padded for at in range(url_filter.ORDER, len(p)) for k in range(url_filter.ORDER + 1)}
    assert len(want) > 500_000 and url_filter.gram_counts(rows).count() == len(want)


def _plain_urls(rows):
    """Counts, probabilities, ratios and verdicts of (url, n times) by dictionaries; rules as the operator gives them."""
    from collections import Counter, defaultdict
    from math import log

    bodies = sorted({(r.host + r.path, None if r.rule is None else r.verdict == "allow") for r in rows}, key=str)
    order, counts = url_filter.ORDER, {True: Counter(), False: Counter()}
    places = lambda body: [(p[at - order : at], p[at]) for p in ["\1" * order + body + "\2"] for at in range(order, len(p))]
    tuning = lambda body: zlib.crc32(body.encode()) % url_filter.FOLDS == 0
    for body, good in bodies:
        if good is not None and not tuning(body):
            for context, char in places(body):
                for k in range(order + 1):
                    counts[good][context[order - k :], char] += 1
    totals = {g: Counter() for g in counts}
    kinds = {g: defaultdict(set) for g in counts}
    for g in counts:
        for (context, char), n in counts[g].items():
            totals[g][context] += n
            kinds[g][context].add(char)

    def probability(g, context, char):
        below = probability(g, context[1:], char) if context else 1 / url_filter.ALPHABET
        c, t = totals[g][context], len(kinds[g][context])
        return (counts[g][context, char] + t * below) / (c + t) if c else below

    ratio = {body: np.mean([log(probability(True, *p)) - log(probability(False, *p)) for p in places(body)]) for body, good in bodies if good is None or tuning(body)}
    return counts, totals, probability, ratio, bodies, tuning


def test_url_models_equal_a_plain_version(spark):
    urls = ["http://" + u for u in random_urls(3, 150, 3)] + ["http://shop.example.net/x", "http://blog.org/y", "http://long.org/" + "abc" * 2000, None, "q", "http://ünï.org/é"] * 2
    got = url_filter.filter_urls(spark.createDataFrame([(k, u, "x", 0) for k, u in enumerate(urls)], "page_id long, url string, verdict string, n int")).collect()
    counts, totals, probability, ratio, bodies, tuning = _plain_urls(got)
    free = [r for r in got if r.rule is None]
    assert free and all(r.ratio == pytest.approx(ratio[r.host + r.path], abs=1e-9) for r in free)
    tuned = [(ratio[b], g) for b, g in bodies if g is not None and tuning(b)]
    accuracy = lambda cut: np.mean([r >= cut for r, g in tuned if g]) + np.mean([r < cut for r, g in tuned if not g])
    cut = url_filter.threshold(spark.createDataFrame([(bool(g), float(r)) for r, g in tuned], "good boolean, ratio double"))
    assert accuracy(cut) == pytest.approx(max(accuracy(k / 100) for k in range(-500, 501)))
    assert all(r.verdict == ("allow" if ratio[r.host + r.path] >= cut else "block") for r in free)


def test_url_contexts_sum_to_one(spark):
    rows = spark.createDataFrame([("abc", True), ("abd", True), ("xbq", False), ("ab", False)], "body string, good boolean")
    counts = url_filter.gram_counts(rows)
    contexts = url_filter.context_counts(counts)
    letters = "abcdqx\2z"
    for context in ("\1\1ab", "zzab", "zzzz", "\1\1\1\1", "\1xbq"):
        grams = spark.createDataFrame([(context + c,) for c in letters], "gram string")
        found = url_filter.gram_scores(grams, counts, contexts).collect()
        unseen = next(r for r in found if r.gram[-1] == "z")  # as likely as any other code point that no URL has
        for p in ("pg", "pb"):
            total = sum(r[p] for r in found) + unseen[p] * (url_filter.ALPHABET - len(letters))
            assert total == pytest.approx(1.0, abs=1e-9)


def test_url_ratios_are_the_same_by_broadcast_and_by_shuffle(spark):
    df = spark.createDataFrame(list(enumerate("http://" + u for u in random_urls(2, 400, 6))), "page_id long, url string")
    one, other = ({r.page_id: r for r in url_filter.filter_urls(df, most_broadcast=m).collect()} for m in (10**9, 0))
    assert len(one) == len(other) == 400 and any(r.ratio for r in one.values())
    for k, r in one.items():
        assert r[:5] == other[k][:5] and (r.ratio == other[k].ratio or abs(r.ratio - other[k].ratio) < 1e-9)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, which is a long sentence about nothing.</div>
<article><h1>Head &amp; line</h1><p><b>First  part.<br><p>Second <a href=x>link</a>ed part, with &lt;signs&gt;.</p><aside>Side</aside><form><input>Sign up</form></article>
<div class="sidebar"><p>Much noise</p></div><section id="comments"><p>I like this very much, says a reader at length.</p></section><footer>Foot</footer></body></html>"""


def test_html(spark):
    assert html_text.extract(PAGE) == "Head & line First part. Second linked part, with <signs>."
    assert html_text.extract("<p>cut <b>off") == "cut off"
    deep = "<div>" * 3000 + "word" + "</div>" * 3000
    assert html_text.extract(deep) == "word"
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (2, None, "", "y"), (3, "v", "<p>" + "long text " * 50_000, "")], "page_id long, url string, html string, text string")
    got = html_text.main_text(df).collect()
    assert html_text.main_text(df.limit(0)).count() == 0
    assert len(got) == 4 and sorted(r.n_chars for r in got) == [0, 0, len("Head & line First part. Second linked part, with <signs>."), 499_999]


def test_html_keeps_an_article_in_several_blocks():
    lines = [" ".join(["word"] * 40) + f" {i}." for i in range(20)]
    half = ["".join(f"<p>{t}</p>" for t in lines[k : k + 10]) for k in (0, 10)]
    links = '<div><a href="/a">one</a> <a href="/b">two</a> <a href="/c">three</a></div>'
    for page in ("<div>{}</div>{}<div>{}</div>", "<div><section>{}</section>{}<section>{}</section></div>", "<section>{}</section>{}<div><div>{}</div></div>"):
        assert html_text.extract("<html><body>" + page.format(half[0], links, half[1]) + "</body></html>") == " ".join(lines)
    aside = "<div>own text of <b>this block</b> " + " ".join(["here"] * 40) + f"<div>{half[0]}</div></div>"
    assert html_text.extract(aside).startswith("own text of this block here") and html_text.extract(aside).endswith(lines[9])


PROSE = [" ".join(["word"] * 30) + f" {i}." for i in range(6)]
BLOCKS = "".join(f"<p>{t}</p>" for t in PROSE)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="page has-sidebar">{BLOCKS}</div>', PROSE),
        (f'<article><div class="article-header"><h1>Title</h1></div>{BLOCKS}</article>', ["Title", *PROSE]),
        (f'<article><header><h1>Title</h1></header>{BLOCKS}</article>', ["Title", *PROSE]),
        (f'<form id="aspnet"><div><h1>Title</h1>{BLOCKS}</div><input></form>', ["Title", *PROSE]),
        (f'<nav><a href="/">Home</a><div>{BLOCKS}</div>', PROSE),
        (f'<div><h2>Title</h2>{BLOCKS}<p>Ok.</p></div><div class="ad">{"Buy this now. " * 9}</div>', ["Title", *PROSE, "Ok."]),
        (f'<div>{BLOCKS}</div><div id="comments">{"<p>I say so, at length, again.</p>" * 60}</div>', PROSE),
        (f'<div>{"<a href=/x>entry</a> " * 40}</div><div><div>{BLOCKS}</div></div>', PROSE),
        (f'<nav>{"<a href=/x>entry</a> " * 9}</nav><div class="ad">{"Buy this now. " * 9}</div><div><h1>One</h1><p>Two</p></div><footer>{"All rights. " * 9}</footer>', ["One", "Two"]),
        (f"{BLOCKS}<ul><li><a href=/a>a</a><li><a href=/b>b</a></ul>", PROSE),
        ("plain text &amp; <b>more</b>", ["plain text & more"]),
        ("<a href=/a>only</a> words", ["only words"]),
    ],
)
def test_html_layouts(page, want):
    assert html_text.extract(f"<html><body>{page}</body></html>") == " ".join(want)


def _plain_density(node):
    """(chars, tags, link chars, link tags) of a nested list [tag, kids...] by recursion."""
    tag, *kids = node
    c = t = lc = lt = 0
    for k in kids:
        if isinstance(k, str):
            c += len(k.replace(" ", ""))
        else:
            a, b, d, e = _plain_density(k)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (k[0] == "a")
    return c, t, (c if tag == "a" else lc), lt


def test_html_densities_equal_a_plain_version():
    import math

    rng = np.random.default_rng(11)
    chosen = 0

    def grow(depth):
        kids = []
        for _ in range(rng.integers(1, 4)):
            if depth and rng.random() < 0.7:
                kids.append([("div", "span", "section", "a")[rng.integers(0, 4 if depth < 3 else 3)], *grow(depth - 1)])
            else:
                kids.append("x" * int(rng.integers(1, 80)))
        return kids

    def no_links_inside(node, inside=False):
        return [node[0] if not (inside and node[0] == "a") else "span", *(k if isinstance(k, str) else no_links_inside(k, inside or node[0] == "a") for k in node[1:])]

    def shown(node):
        return "".join(k if isinstance(k, str) else f"<{k[0]}>{shown(k)}</{k[0]}>" for k in node[1:])

    for _ in range(150):
        tree = no_links_inside(["body", *grow(4)])
        c, t, lc, lt = _plain_density(tree)
        share = lc / c

        def density(node):
            c, t, lc, lt = _plain_density(node)
            inner = c / max(1, lc) * max(1, t) / max(1, lt)
            return c / max(1, t) * math.log(inner) / math.log(c / max(1, c - lc) * lc + share * c + math.e) if c and inner > 1 else 0.0

        body = html_text.parse(shown(tree))
        html_text.measure(body)
        stack, best = [(tree, body)], -1.0
        while stack:
            want, got = stack.pop()
            assert (got.chars, got.tags, got.link_chars, got.link_tags) == _plain_density(want)
            assert got.density == pytest.approx(density(want))
            kids = [k for k in want[1:] if not isinstance(k, str)]
            total = sum(map(density, kids))
            assert got.total == pytest.approx(total)
            best = max(best, total)
            stack.extend(zip(kids, got.nodes(), strict=True))
        assert body.best.total == pytest.approx(best)
        nodes = {id(body): (tree, body)}
        stack = [(tree, body)]
        while stack:
            want, got = stack.pop()
            pairs = list(zip([k for k in want[1:] if not isinstance(k, str)], got.nodes(), strict=True))
            nodes |= {id(n): (k, n) for k, n in pairs}
            stack += pairs

        def sum_of(tree):
            return sum(density(k) for k in tree[1:] if not isinstance(k, str))

        def heaviest(tree):
            """The largest sum of a subtree, the outermost and first of equals."""
            best = (sum_of(tree), tree)
            for k in tree[1:]:
                if not isinstance(k, str) and (below := heaviest(k))[0] > best[0] + 1e-12:
                    best = below
            return best

        main = next(n for t, n in nodes.values() if t is heaviest(tree)[1])
        while True:
            of = nodes[id(main)][0]
            inside = [k for k in of[1:] if not isinstance(k, str) and k[0] in ("div", "section")]
            heavy = max(inside, key=lambda k: heaviest(k)[0], default=None)
            if heavy is None or heaviest(heavy)[0] <= sum_of(of) - density(heavy):
                break
            main = next(n for t, n in nodes.values() if t is heaviest(heavy)[1])
        assert html_text.main_node(body) is main
        whole, own, cut = html_text.main_parts(body)
        least = min(density(nodes[id(n)][0]) for n in html_text._path(main))
        assert not cut and (main is body or main in whole)
        for n in whole - {main}:
            if main is not body:
                assert any(density(nodes[id(p)][0]) >= least - 1e-9 for p in html_text._path(n)) and max(n.total, n.density) > 0
        assert html_text.text_of(main, whole, own, cut) and html_text.text_of(body, whole, own, cut).count("x") <= body.chars
        chosen += main is not body
    assert chosen > 75


ELEMENTOR = "".join(f'<div class="elementor-widget elementor-widget-text"><div class="elementor-widget-container"><p>{t}</p></div></div>' for t in PROSE)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="elementor">{ELEMENTOR}</div><footer>All rights reserved by nobody at all, ever.</footer>', PROSE),
        (f'<div class="layout-sidebar-right"><h1>Title</h1>{BLOCKS}</div><div><p>Imprint: nobody, nowhere, 12345 Town.</p></div>', ["Title", *PROSE]),
        (f'<article><h1>Title</h1>{BLOCKS}<section class="social-policy"><p>{PROSE[0]}</p><p>{PROSE[1]}</p></section></article>', ["Title", *PROSE, *PROSE[:2]]),
        (f"<article><h1>Title</h1>{BLOCKS}<fieldset><p>{PROSE[2]}</p></fieldset></article><footer>Rights.</footer>", ["Title", *PROSE, PROSE[2]]),
        (f'<article>{BLOCKS}<div class="social-share"><a href="/a">Share</a> this <a href="/b">now</a></div></article>', PROSE),
        (f'<div class="site-header"><p>Our motto is long enough to be text.</p></div><div>{BLOCKS}</div>', PROSE),
    ],
)
def test_html_names_weigh_and_do_not_choose(page, want):
    assert html_text.extract(f"<html><body>{page}</body></html>") == " ".join(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_html_density_alone_gives_the_text_of_most_pages(monkeypatch):
    """Without any name, the densities choose the same text on most pages, and less than all of the body on nearly all."""
    import pyarrow.parquet as pq

    pages = [p for p in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if p]
    named = [html_text.extract(p) for p in pages]
    monkeypatch.setattr(html_text, "_names_itself", lambda *_: False)
    alone = [html_text.extract(p) for p in pages]
    bodies = [html_text.text_of(b := html_text.parse(p), {b}, set(), set()) for p in pages]
    assert sum(a == n for a, n in zip(alone, named, strict=True)) > 0.8 * len(pages)
    assert sum(a != b for a, b in zip(alone, bodies, strict=True)) > 0.9 * len(pages)


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_html_density_decides_without_an_article_tag(tag):
    """The same text whatever the article's element is called, and only the article's part of all the page's text."""
    rng = np.random.default_rng(5)
    for k in range(40):
        paragraphs = [prose(1000 * k + j, int(rng.integers(1, 60))) for j in range(int(rng.integers(1, 12)))]
        links = "".join(f'<li><a href="/{i}">menu entry {i}</a></li>' for i in range(8))
        page = f"<body><div><ul>{links}</ul></div><{tag}><h1>{paragraphs[0]}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</{tag}><div><a href='/i'>imprint</a> <a href='/p'>privacy</a></div></body>"
        assert html_text.extract(page) == " ".join([paragraphs[0], *paragraphs])


def test_pipeline_stages_equal_plain_versions(spark, tmp_path):
    """Each stage on its own input against brute force, and run() as the stages one after the other."""
    import corpus_pipeline
    from glyphmill.llm import pieces

    english = [f"the cat and the dog of that house number {k} with them " for k in range(30)]
    item = prose(700, 40)
    rows = [(k, english[k] + prose(800 + k, 40), "en") for k in range(25)]
    rows += [(30, rows[0][1], "en"), (31, rows[1][1] + " and one more", "en"), (32, rows[2][1] + " " + prose(900, 30), None), (33, "12 34", None), (34, None, None), (35, "", "de")]
    rows += [(36, prose(901, 30) + " " + item, "en"), (37, english[3] + prose(803, 40)[:150] + prose(902, 60), "en")]
    rows = [(i, t, lang, "src", None if t is None else len(t), 1.5) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = stage(spark, now, str(tmp_path))
        if name != "sentence_pieces":
            assert kept[name].columns == docs.columns
        before, now = {r.doc_id: r for r in now.collect()}, spark.createDataFrame(kept[name].collect(), kept[name].schema)
        after = {r.doc_id: r for r in now.collect()}
        if name == "language_id":
            assert set(before) - set(after) >= {33, 34, 35} and set(range(25)) <= set(after)
        elif name == "near_duplicates":
            want = brute_components([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i in before if want[i][1] == i} and {30, 31} & set(after) == set()
        elif name == "repeated_strings":
            want = brute_repeats([(i, r.text) for i, r in before.items()], 100)
            assert {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in after.items()} == {i: w[2] for i, w in want.items() if w[0] > w[1]}
            assert all(r.n_chars == len(r.text) for r in after.values()) and any(w[1] for w in want.values())
        elif name == "decontamination":
            assert set(before) - set(after) == {36}
        else:
            codec = pieces.Codec(public_tokenizers.path(corpus_pipeline.PIECES), 4)
            assert all(codec.decode(np.array(r.ids)) == before[i].text for i, r in after.items()) and set(after) == set(before)
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {r.doc_id: r.ids for r in kept["sentence_pieces"].collect()}
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_empty_documents(docs):
    none = docs.limit(0)
    assert ngram_join.join_components(none).count() == repeats.repeats(none).count() == digests.fingerprints(none).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, public_tokenizers.path("word_bpe_49k.json"))).count() == 0
