"""The text operators against brute force, with nulls, empty and long texts, repeated rows and extra columns."""

import random
import re
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe_codec
from quillspark.llm.bpe_codec import block_rows, bpe_decode, bpe_encode, encode_words, pack, unpack
from quillspark.llm.components import components
from quillspark.llm.fingerprints import edited_fingerprints, fingerprints, likeness, locate_edits, merkle, parsed
from quillspark.llm.language_id import language_id
from quillspark.llm.ngram_join import FILTER_BITS, Join, key_filter, ngram_jaccard_join
from quillspark.llm.pretokens import Splitter, read_file
from quillspark.llm.runtime import Scratch, trimmed
from quillspark.llm.secrets import log10_guesses, ranked, redacted, scan, secret_scan, segments, uncovered, written
from quillspark.llm.substring_dedup import matches, parse, substring_dedup
from quillspark.llm.token_counts import Lengths, token_counts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "el", "ir", "ost", "un")]


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    rows = [(k, text(rng.choice([3, 12, 60, 150]))) for k in range(n)]
    base = text(160).split()
    for k in range(30):  # near copies, some chains, some too far apart
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((100 + k, " ".join(words)))
    passage = text(70)
    rows += [(200 + k, f"{text(20)}\n{passage}\t{text(5 + k)}") for k in range(6)]
    rows += [(300, rows[0][1]), (301, rows[2][1]), (302, base and " ".join(base)), (303, " ".join(base))]
    rows += [(400, None), (401, ""), (402, "   \n"), (403, "one"), (404, "ONE"), (405, "la la " * 80), (406, "la la " * 90), (407, text(9000)), (408, "Ünï cödé 日本  x")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([(i, t, "k", i, 0) for i, t in rows], "doc_id long, text string, keys string, n long, label int").repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def split_words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text, n):
    w = split_words(text, True)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("n", "threshold"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(docs, n, threshold):
    sets = {i: shingles(t, n) for i, t in corpus()}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    got = by_id(ngram_jaccard_join(docs, n, threshold))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join_of_a_large_group_and_of_nothing(spark):
    rng = random.Random(1)
    base = [rng.choice(WORDS) + str(k) for k in range(120)]
    rows = []
    for k in range(80):
        words = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            words[j] = f"x{k}y{j % 7}"
        rows.append((k, " ".join(words)))
    sets = {i: shingles(t, 3) for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = by_id(ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90))
    assert {i: r.component_id for i, r in got.items()} == label
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(none).count() == 0
    repeated = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (None, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_jaccard_join(repeated, 3, 90).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_ngram_join_counts_every_link(spark, docs):
    rng = random.Random(6)
    base = [rng.choice(WORDS) + str(k) for k in range(150)]
    large = []
    for k in range(60):
        words = list(base)
        for j in rng.sample(range(150), rng.choice([1, 1, 2, 4])):
            words[j] = f"x{k}"
        large.append((1000 + k, " ".join(words)))
    rows = corpus() + large + [(2000 + k, large[k % 3][1]) for k in range(9)]
    more = spark.createDataFrame([(i, t, "k", i, 0) for i, t in rows], docs.schema)
    sets = {i: shingles(t, 3) for i, t in rows}
    near = lambda a, b: a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    want = {a: sum(bool(near(a, b)) for b in sets) for a in sets}
    assert {i: r.n_links for i, r in by_id(ngram_jaccard_join(more, 3, 90)).items()} == want
    assert max(want.values()) > 20


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (3, 2)], "a long, b long")
    assert {r.node: r.label for r in components(edges, Scratch(spark)).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_substring_dedup_equals_brute_force(spark, docs):
    rows = sorted(corpus())
    first, kept = {}, {}
    for i, t in rows:
        w = split_words(t)
        gone = set()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone.update(range(k, k + 50))
        kept[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    got = by_id(substring_dedup(docs))
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == kept
    assert sum(n for _, n, _ in kept.values()) > 1000
    assert all(sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed for r in got.values())
    long = " ".join(f"w{k}" for k in range(60))
    odd = spark.createDataFrame([(5, long), (5, long + " more"), (None, long), (6, "x " + long)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(odd).collect()) == [(0, 60, 0), (5, 60, 0), (5, 61, 0), (6, 61, 60)]
    assert substring_dedup(odd.limit(0)).count() == 0


def test_greedy_parse_covers_what_all_matches_cover():
    rng = random.Random(4)
    for _ in range(100):
        spans = [(a, a + rng.randrange(1, 12)) for a in (rng.randrange(40) for _ in range(8))]
        import numpy as np

        begin, end = parse(*map(np.array, zip(*spans)))
        cover = lambda xs: {(a + k, a + k + 5) for a, b in xs for k in range(b - a - 4)}
        assert cover(zip(begin.tolist(), end.tolist())) == cover(spans) and list(end) == sorted(end)
    x, ref = np.array([9, 1, 2, 3, 4, 8], np.uint64), np.array([0, 1, 2, 3, 4], np.uint64)
    assert [a.tolist() for a in matches(x, np.array([2, 0]), ref, np.array([2, 0]), 2)] == [[1], [5]]


SPECIAL = ["Hello<|endoftext|>World <|startoftext|>!", "İstanbul ΣΑΣ ŉ ſ don't WE'LL !!'s", "é café \x85\xa0\x1c", "日本語 ½ 12", "­ ªº ﬁ ẞ 😀", "ܼİ", "a\x00b"]


def test_token_counts_and_codec_equal_the_library(spark, docs):
    library = Tokenizer.from_file(TOKENIZER)
    more = spark.createDataFrame([(1000 + k, t, "x", 0, 0) for k, t in enumerate(SPECIAL)], docs.schema)
    both = docs.union(more)
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    counts = by_id(token_counts(both, TOKENIZER, limit=2048))
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in counts.items()} == {i: (len(texts[i].encode()), len(x), len(x) > 2048) for i, x in ids.items()}
    coded = by_id(bpe_encode(both, TOKENIZER))
    decoded = {i: library.decode(x, skip_special_tokens=False) for i, x in ids.items()}
    assert {i: (r.ids, r.decoded) for i, r in coded.items()} == {i: (ids[i], decoded[i]) for i in ids}
    again = spark.createDataFrame([(1, ids[0]), (2, None), (3, [5, 999_999, 6])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe_decode(again, TOKENIZER).collect()} == {1: decoded[0], 2: "", 3: library.decode([5, 6], skip_special_tokens=False)}
    assert token_counts(docs.limit(0), TOKENIZER).count() == 0 and bpe_encode(docs.limit(0), TOKENIZER).count() == 0


def test_codec_lets_go_of_what_is_stored():
    """Texts of a block as they are stored; words of a group when the next one comes."""
    texts = [np.array([0, 1, 1], np.uint32) for _ in range(200)]
    rows = block_rows("0-0", list(range(200)), texts, {"b": 0, "a": 1}, 8)
    first = next(rows)
    assert texts[0] is None and texts[-1] is not None and unpack(first[4]).tolist()[:3] == [1, 0, 0]
    assert sorted(w for *_, blob in rows if blob for w in zstandard.ZstdDecompressor().decompress(blob).decode().split("\n")) == ["a", "b"]


def test_codec_keeps_the_words_of_one_group(monkeypatch):
    split, met = Splitter(read_file(TOKENIZER)), []
    monkeypatch.setattr(bpe_codec, "splitter", lambda file: SimpleNamespace(encode=lambda w: met.append(w) or split.encode(w)))
    asked = [(1, "x", "one\nunheardofword"), (1, "y", "one"), (2, "x", "two"), (3, "x", "one")]
    group, block, words = zip(*asked, strict=True)
    places = [pack(np.arange(len(w.split()), dtype=np.uint32)) for w in words]
    batch = pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(block), pa.array(places), pa.array([zstandard.compress(w.encode()) for w in words])], names=["word_group", "block", "positions", "words"])
    (out,) = encode_words(SimpleNamespace(value=""))([batch])
    assert met == ["one", "unheardofword", "two", "one"] and out.column("block").to_pylist() == list(block)
    assert [unpack(x).tolist() for x in out.column("ids").to_pylist()] == [[i for w in ws.split() for i in split.encode(w)] for ws in words]
    assert [unpack(x).tolist() for x in out.column("counts").to_pylist()] == [[len(split.encode(w)) for w in ws.split()] for ws in words]


def test_trimmed_workers_give_memory_back():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024

    pins = []

    def run(batches):
        for n in batches:
            many = [bytearray(2000) for _ in range(n)]
            pins.append(bytearray(2000))  # keeps the end of the heap in use
            yield len(many)

    before = held()
    assert list(trimmed(run)([50_000])) == [50_000]
    assert held() < before + 50  # 100 MB are free again


def test_driver_gives_memory_back_with_each_table(spark):
    jvm, scratch = spark._jvm, Scratch(spark)

    def held():
        with open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024

    scratch.save(spark.range(10), "first")
    jvm.java.util.zip.Deflater().end()  # from then on, malloc keeps blocks of such a size when they are freed
    native = [jvm.java.util.zip.Deflater() for _ in range(1000)]  # 128 KB each that are written to, outside the heap
    for k, x in enumerate(native):
        if k % 20:  # the others keep the pages between in use
            x.end()
    before = held()
    assert scratch.save(spark.range(10), "second").count() == 10
    assert held() < before  # though the table itself takes memory


def test_splitter_equals_the_library():
    """Every character below U+0300 alone and between letters, and random strings of them."""
    split, library = Splitter(read_file(TOKENIZER)), Tokenizer.from_file(TOKENIZER)
    rng = random.Random(12)
    letters = [chr(c) for c in range(1, 0x300)]
    texts = [t for c in letters for t in (c, f"a{c}b", f" {c} X")] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    texts += ["MƏN Bakıda yaşayıram", "ŭȈāɄłȲĵŤ¾Ċ", *SPECIAL]
    for text in texts:
        assert [i for w in split.split(text) for i in split.encode(w)] == library.encode(text, add_special_tokens=False).ids, text


def test_token_counts_keep_their_caches():
    split = Splitter(read_file(TOKENIZER))
    kept = Lengths(split)
    table = {"hello": 1}
    kept.start(table)
    first = kept["unheardofword"]
    kept.start(dict(table))
    assert dict.__contains__(kept, "unheardofword") and kept["unheardofword"] == first == len(split.encode("unheardofword"))


def test_packed_lists_round_trip():
    import numpy as np

    for values in ([], [0], [191, 192, 255, 256, 16_319, 16_320, 70_000, 2**32 - 1], list(range(0, 40_000, 7))):
        assert unpack(pack(np.array(values, np.uint32))).tolist() == values


def test_language_id_learns_from_training_rows_only(spark):
    rng = random.Random(2)
    kinds = {"aa": ["salo", "mira", "tolu"], "bb": ["xekz", "qwix", "zzyx"]}
    rows = [(k, " ".join(rng.choice(kinds[g]) for _ in range(30)), g) for k in range(120) for g in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (None, "salo mira salo", "bb"), (903, "xekz " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id(df).collect()
    assert len(got) == len(rows)
    lang = {i: g for i, _, g in rows}
    held = [r for r in got if r.held_out]
    assert held and all(r.lang_pred == lang[r.doc_id] for r in held if r.doc_id < 200)
    found = {r.doc_id: r for r in got}
    assert [found[k].lang_pred for k in (900, 901, 902, None, 903)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id(df.filter("lang is null")).collect()} == {"und"}


def test_language_id_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    kinds = {"aa": ["salo", "mira", "tolu"], "bb": ["xekz", "qwix", "sami"]}
    rows = [(k, " ".join(rng.choice(kinds[g]) for _ in range(9)), g) for k in range(300) for g in [rng.choice(["aa", "bb"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in language_id(df.repartition(2)).collect()} == {tuple(r) for r in language_id(df.repartition(7, "text")).collect()}


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(docs).filter("held_out").join(docs.filter("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def brute_secrets(text):
    kinds = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
    ]
    spans = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    return ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secret_scan(spark):
    texts = [None, "", "é password = 'abc' PASSWD:\"hunter22\"", "Token=AKIA" + "A1" * 9, "x" * 10 + "0a" * 20, "ſecret = abcdefgh", "api_key: " + "f0" * 13 + " tail", "AKIAAKIA" * 3, "pwd: x9$Lq2!vRt8Z. and pin is password123"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan(df).withColumn("base", written(F.filter("spans", lambda s: s["kinds"] != "guess"))).withColumn("all", written(F.col("spans"))).withColumn("clean", redacted(F.col("text"), F.col("spans")))
    got = by_id(found)
    assert {i: r.base for i, r in got.items()} == {i: brute_secrets(t or "") for i, t in enumerate(texts)}
    assert got[8]["all"] == "guess:5:17" and got[8].clean == "pwd: [SECRET]. and pin is password123"
    assert got[0].clean is None and got[6].clean == "[SECRET] tail" and got[4].clean == "x" * 10 + "[SECRET]"


def test_secrets_that_fixed_patterns_cut_short_are_marked_whole(spark):
    texts = ['password: "tr0ub4dor&3xK!9z" end', 'token = "f3ef4d6b2755a36d7d9c" end', "secret=" + "0a" * 13 + "#Qz7$Lw end"]
    got = by_id(secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumns({"all": written(F.col("spans")), "clean": redacted(F.col("text"), F.col("spans"))}))
    assert [got[k].clean for k in range(3)] == ['[SECRET]" end', '[SECRET]" end', "[SECRET] end"]
    assert got[0]["all"] == "assign:0:20,guess:11:27" and "guess" not in got[1]["all"]


def cheapest(value, ranks):
    """The price of the cheapest of all segmentations, each tried."""
    priced = {}
    for a, b, price in segments(value, ranks):
        priced.setdefault(a, []).append((b, price))

    def rest(at):
        return 0.0 if at == len(value) else min(price + rest(to) for to, price in priced[at])

    return rest(0)


def test_guess_cost_is_that_of_the_cheapest_segmentation():
    rng = random.Random(7)
    ranks = ranked(["maple", "river", "ple"])
    parts = ["maple", "R1v3r", "2023", "qwe", "aaa", "xY", "12-5-1999", "ab", "İ", "pass"]
    for _ in range(150):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))[:12]
        assert log10_guesses(value, ranks) == pytest.approx(cheapest(value, ranks)), value
    known = {(a, b): p for a, b, p in segments("maple", ranks)}
    assert known[0, 5] < log10_guesses("maplx", ranks) and log10_guesses("maple", ranked([])) > log10_guesses("maple", ranks)
    assert log10_guesses("İ" * 20 + "x9$Lq2!vRt8Z") > log10_guesses("x9$Lq2!vRt8Z") > 9


def test_corpus_words_are_cheap_and_spans_are_found_in_linear_time(spark):
    rows = [(k, "The secret is patiencewins and patiencewins again") for k in range(3)] + [(9, "my password is zq7Kd-Wm2x now"), (9, "my password is zq7Kd-Wm2x now"), (10, "x " * 100_000 + "pwd: Kp3vQz81Lm"), (11, None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, spans string")
    got = secret_scan(df, carry=("spans",)).collect()
    assert len(got) == 7 and got[0].asDict().keys() == {"doc_id", "text", "spans"}
    found = {r[0]: [s.kinds for s in r[3]] for r in got}
    assert found == {0: [], 1: [], 2: [], 9: ["guess"], 10: ["guess"], 11: []}
    assert secret_scan(df.limit(0)).count() == 0
    rng = random.Random(5)
    for _ in range(200):
        base = sorted((a, 0, a + rng.randrange(1, 9)) for a in rng.sample(range(60), 6))
        values = sorted((a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), 6))
        values = [v for k, v in enumerate(values) if not k or v[0] >= values[k - 1][1]]
        held = {x for a, _, b in base for x in range(a, b)}
        assert uncovered(values, base) == [any(x not in held for x in range(a, b)) for a, b in values]
    assert [s[3] is not None for s in scan("password=hunter2x AKIA" + "A" * 16, 9.0)] == [True, False]


def test_guess_costs():
    weak, strong = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "2023-11-05", "abcabcabcabc", "changeme2020"], ["x9$Lq2!vRt8Z", "f3ef4d6b2755a36d7d9c", "Kp3vQz81Lm"]
    assert max(map(log10_guesses, weak)) < 6 < 9 < min(map(log10_guesses, strong))
    assert log10_guesses("") == 0 and log10_guesses("a" * 20_000) < 10


def test_fingerprints(spark, docs):
    rows = sorted(corpus())
    got = by_id(edited_fingerprints(docs))
    prints = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert (r.n_chars, r.edited) == (len(t), edited)
        assert prints.setdefault(r.fingerprint, t) == t and prints.setdefault(r.edited_fingerprint, edited) == edited
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1) == (t == edited)
    assert got[407].near_edited > 0.5 > got[407].near_next
    assert got[302].near_next == 1.0
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    assert edited_fingerprints(odd).count() == 4 and edited_fingerprints(odd.limit(0)).count() == 0
    assert fingerprints(odd).select("fingerprint").distinct().count() == 3


def plain_tree(text):
    """Sections of paragraphs of pieces."""
    import regex

    paragraphs = lambda part: [regex.findall(r"[^.!?]{1,48}[.!?]{0,8}[ \t-\r]?|[.!?]{1,8}[ \t-\r]?", line) for line in regex.split(r"(?V1)(?<=\n)", part)]
    return [paragraphs(part) for part in regex.split(r"(?V1)(?<=\n\n)", text)]


def plain_likeness(a, b):
    """Walks both trees: an equal section or paragraph is shared whole, others by their pieces."""
    size = lambda pieces: sum(map(len, set(pieces)))
    x, y = ([p for s in plain_tree(t) for line in s for p in line] for t in (a, b))
    assert "".join(x) == a and "".join(y) == b
    return 1.0 if a == b else min(2 * size(set(x) & set(y)) / max(size(x) + size(y), 1), 0.999999)


def test_likeness_equals_that_of_plain_trees(spark):
    rng = random.Random(8)
    lines = [f"Line {k} of text, longer than a piece can ever be in these trees. It ends!?\n" + "\n" * (k % 7 == 0) for k in range(300)]
    texts = ["".join(lines), "".join(lines[:299]) + "Other end.\n", "".join(f"New {k}.\n" for k in range(280)) + "".join(lines[:20]), "", "One line", "日本語 é 😀. " * 40, "...." * 30]
    texts += ["".join(rng.choice(lines) for _ in range(rng.randrange(30))) for _ in range(20)]
    got = by_id(edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        assert got[k].near_next == pytest.approx(plain_likeness(text, after)) and got[k].near_edited == pytest.approx(plain_likeness(text, got[k].edited))
        node = lambda s: tuple(tuple(line) for line in s)
        old = plain_tree(text)
        edits = [(i, j) for i, s in enumerate(plain_tree(got[k].edited)) if node(s) not in set(map(node, old)) for j, line in enumerate(s) if line not in [x for y in old for x in y]]
        assert [(e.section, e.paragraph) for e in got[k].edits] == edits
    again = spark.createDataFrame([(got[0].fingerprint, got[1].fingerprint)], "a string, b string").select(likeness(parsed(F.col("a")), parsed(F.col("b"))).alias("x")).first().x
    assert again == pytest.approx(got[0].near_next)


def test_differing_branches_locate_edits(spark):
    before, after = "One. Two.\nThree.\n\nFour.\nFive.\n\nSix.", "One. Two.\nThree.\n\nFour.\nFife.\n\nSix."
    row = spark.createDataFrame([(before, after)], "a string, b string").select(locate_edits(merkle(F.col("a")), merkle(F.col("b"))).alias("e")).first()
    assert [(x.section, x.paragraph) for x in row.e] == [(1, 1)]


def test_the_filter_of_shared_keys_reaches_the_driver_as_bits(spark, monkeypatch):
    sent, frame = [], type(spark.range(1))
    real = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: (sent.append(real(self)), sent[-1])[1])
    places = 3 * np.arange(1 << 19)  # two or three bits of each byte in a stretch of the filter
    got = key_filter(spark.range(1 << 19).select(F.shiftleft(F.col("id") * 3, 64 - FILTER_BITS).alias("key")))
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[places] = True
    assert np.array_equal(np.unpackbits(got.view(np.uint8), bitorder="little").astype(bool), bits)
    assert sum(t.nbytes for t in sent) < 1.1 * (3 << 19) / 8


def test_the_join_broadcasts_no_side_that_is_small_in_its_file_only(spark):
    """400 rows in a file of some KB explode to 80,000, several MB, of which the driver would get all."""
    fixed = "spark.sql.autoBroadcastJoinThreshold"
    before, store = spark.conf.get(fixed), spark._jsparkSession.sharedState().statusStore()

    def broadcasts(scratch, name):
        rows = Scratch(spark).save(spark.range(0, 400, 1, 1).select(F.col("id").alias("a"), F.sequence(F.lit(1), F.lit(200)).alias("ks")), "rows")
        exploded = rows.select("a", F.explode("ks").alias("k"))
        out = scratch.save(exploded.join(Scratch(spark).save(spark.range(100_000).select((F.col("id") % 500).alias("a"), (F.col("id") % 7).cast("int").alias("k")), "others"), ["a", "k"]), name)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        run = store.executionsList().last()
        assert out.count() == exploded.join(spark.range(100_000).selectExpr("id % 500 AS a", "CAST(id % 7 AS int) AS k"), ["a", "k"]).count() > 0
        assert f"/{name}-" in run.physicalPlanDescription()
        return run.physicalPlanDescription().split("== Initial Plan ==")[0].count("BroadcastExchange")

    try:
        spark.conf.set(fixed, "64k")
        join = Join(spark.createDataFrame([], "doc_id long, text string"), 5, 80, False)
        assert broadcasts(Scratch(spark), "plain") and not broadcasts(join.scratch, "measured")
        assert spark.conf.get(fixed) == "64k" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
    finally:
        spark.conf.set(fixed, before)
