"""Quality, contamination, conversations and the pipeline."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm.chat_format import format_conversations, parse
from quillspark.llm.decontaminate import Index, contamination, prints
from quillspark.llm.quality import expectation_maximisation, quality

WORDS = [f"{a}{b}{c}" for a in "bcdfgh" for b in ("an", "el", "ir") for c in ("ta", "no", "rus", "")]


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def prose(rng, n=12):
    return " ".join(sentence(rng, rng.randrange(5, 12)) for _ in range(n))


def junk(rng, k):
    words = [rng.choice(WORDS) for _ in range(80)]
    return [" ".join(w + "%%%" for w in words), " ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(w for w in words[:4] for _ in range(30))][k % 4]


def quality_rows():
    rng = random.Random(4)
    rows = [(k, prose(rng), 1) for k in range(150)] + [(200 + k, junk(rng, k), 0) for k in range(40)]
    return [*rows, (300, None, 0), (301, "", 0), (302, "Fine words here.", 1), (303, rows[0][1], 1), (303, rows[0][1], 1)]


def test_quality_keeps_clean_documents_and_rejects_junk(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows], "doc_id long, text string, source string, score double")
    got = quality(df).collect()
    assert len(got) == len(rows)
    truth = {i: bool(q) for i, _, q in rows}
    wrong = [r for r in got if r.keep != truth[r.doc_id]]
    assert not [r for r in wrong if truth[r.doc_id]] and len(wrong) <= 2
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert quality(df.limit(0)).count() == 0


def test_quality_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in quality_rows()], "doc_id long, text string")
    show = lambda d: sorted((r.doc_id, round(r.score, 12), r.keep) for r in quality(d).collect())
    assert show(df.repartition(2)) == show(df.repartition(7, "text"))


def unlike_any_of_a_few_thousand(spark):
    """More rows than 4,000, and the ids of those of a kind that no row has which a draw of 4,000 by hash took."""
    rng = random.Random(9)
    rows = [(k, prose(rng, 4)) for k in range(4500)] + [(5000 + k, junk(rng, k % 3)) for k in range(90)]
    repeats = spark.createDataFrame([(10_000 + k, junk(rng, 3)) for k in range(400)], "doc_id long, text string")
    place = F.xxhash64("doc_id", "text", F.lit("quality"))
    rare = [(r.doc_id, r.text) for r in repeats.filter(place > (1 << 63) - (1 << 60)).collect()]  # the last 16th of the hashes
    assert len(rare) >= 10
    return spark.createDataFrame(rows + rare, "doc_id long, text string"), {i for i, _ in rare}


def test_quality_learns_from_every_document(spark):
    df, rare = unlike_any_of_a_few_thousand(spark)
    got = [r for r in quality(df).collect() if r.doc_id in rare]
    assert len(got) == len(rare) and all(r.score < 0.5 and not r.keep for r in got)


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert len(good) > 100 and sum(r.keep for r in good) >= 0.97 * len(good) and sum(not r.keep for r in bad) >= 0.9 * len(bad)


def test_expectation_maximisation_learns_a_mostly_bad_corpus():
    good, bad = sum(1 * 4**k for k in range(8)), sum((0 if k in (1, 2) else 1) * 4**k for k in range(8))
    posterior, prior, _ = expectation_maximisation(np.array([good, bad]), np.array([10.0, 90.0]))
    assert posterior[0] > 0.9 > 0.1 > posterior[1] and 0.05 < prior < 0.15


def test_expectation_maximisation_separates_two_kinds():
    good, bad = sum(1 * 4**k for k in range(8)), sum((0 if k in (1, 2) else 1) * 4**k for k in range(8))
    posterior, prior, _ = expectation_maximisation(np.array([good, bad]), np.array([90.0, 10.0]))
    assert posterior[0] > 0.9 > 0.1 > posterior[1] and 0.85 < prior < 0.95


def brute_contamination(docs, items):
    """Every window against every item, with the weights of the whole benchmark."""
    out = {}
    split = [(j, (u or "").encode().lower().split()) for j, u in items]
    grams = {k: Counter(tuple(v[x : x + min(5, len(v))]) for x in range(len(v) - min(5, len(v)) + 1)) for k, (j, v) in enumerate(split) if v and j is not None}
    total, owners = len(grams), Counter(g for own in grams.values() for g in own)
    for i, t in docs:
        w = (t or "").encode().lower().split()
        for number, own in grams.items():
            j, v = split[number]
            k, n = min(5, len(v)), min(len(v), len(w))
            if n < k:
                continue
            weight = lambda g, own=own: np.log1p(total / owners[g]) if g in own else np.log1p(total)
            whole = sum(c * weight(g) for g, c in own.items())
            for s in range(len(w) - n + 1):
                mine = Counter(tuple(w[x : x + k]) for x in range(s, s + n - k + 1))
                if not mine.keys() & own.keys():
                    continue
                common = sum(c * weight(g) for g, c in (mine & own).items())
                found = common / (sum(c * weight(g) for g, c in mine.items()) + whole - common)
                if found >= 0.8 - 1e-9 and found > out.get((i, j), 0):
                    out[i, j] = found
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(14, 40)))) for k in range(25)] + [(90, None), (91, ""), (92, "xylo phone quartz")]
    docs = [(k, prose(rng)) for k in range(40)]
    for k in range(25):
        w = items[k][1].split()
        docs.append((100 + k, f"{prose(rng, 3)} {items[k][1].upper() if k % 2 else items[k][1]} {prose(rng, 2)}"))
        w[0] = "changed"
        docs.append((200 + k, f"{prose(rng, 2)}\n{' '.join(w)}\n{prose(rng, 2)}"))
        docs.append((300 + k, " ".join(items[k][1].split()[: len(w) // 2])))
    docs += [(400, None), (401, ""), (402, "a Xylo phone quartz b"), (403, items[3][1]), (403, items[4][1]), (404, items[5][1] * 1 + " " + " ".join(rng.choice(WORDS) for _ in range(30_000)))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, start int")
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    got = contamination(df, bench).collect()
    want = brute_contamination(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    assert all(r.similarity == pytest.approx(want[r.doc_id, r.item_id]) for r in got if r.doc_id != 403)
    parts = contamination(df, bench, at_a_time=3).collect()
    assert sorted(map(str, parts)) == sorted(map(str, got))  # the same weights, however the benchmark is cut
    assert contamination(df.limit(0), bench).count() == 0 and contamination(df, bench.limit(0)).count() == 0


def test_damaged_items_are_recalled(spark):
    rng = random.Random(21)
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(16, 70)))) for k in range(60)]
    docs = []
    for k, text in items:
        for d in range(6):  # words lost at either end, changed near the ends, or put in
            w = text.split()
            for _ in range(d % 3):
                w.pop(0 if rng.random() < 0.5 else -1)
            if d > 3:
                w[rng.choice([0, 1, -1, -2])] = "other"
            docs.append((1000 * d + k, f"{prose(rng, 2)} {' '.join(w)} {prose(rng, 2)}"))
    want = set(brute_contamination(docs, items))
    got = {(r.doc_id, r.item_id) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 250 and len(got) >= 0.95 * len(want)


class Counts(dict):
    def __missing__(self, key):
        return 1


def test_hamming_blocks_find_every_fingerprint_within_the_radius():
    import pyarrow as pa

    rng = np.random.Generator(np.random.PCG64(1))
    index = Index(list(range(60)), pa.array([" ".join(f"w{rng.integers(40)}" for _ in range(20)) for _ in range(60)]), 5, Counts(), 60)
    members, codes = index.tables[20]
    noisy = codes ^ np.packbits(rng.random((len(codes), 128)) < 0.2, axis=1)
    window, item, _ = index.near(noisy, 20)
    apart = np.bitwise_count(noisy[:, None, :] ^ codes[None]).sum(axis=2)
    assert set(zip(window.tolist(), item.tolist())) == {(int(a), int(members[b])) for a, b in zip(*np.nonzero(apart <= 31))}
    assert prints(np.zeros(0, np.uint64), np.zeros(0, np.int64), 5).shape == (0, 16)


def reply_fixture(seed=5):
    rng = random.Random(seed)
    rows, expected = [], {}
    for c in range(12):
        n, own, parent = rng.choice([1, 4, 15]), [], {}
        for t in range(n):
            body = [f"{rng.choice(WORDS)} {c} {t} {k} {rng.choice(WORDS)}." for k in range(3)]
            own.append(body)
            text = " ".join(body)
            if t and rng.random() < 0.7:
                p = parent[t] = rng.randrange(t)
                quote = "\n".join("> " + x for x in own[p][:2])
                if p in parent:
                    quote += "\n>> " + own[parent[p]][0]
                text = f"On Monday X wrote:\n{quote}\n\n{text}"
            rows.append((c, t, rng.choice(["user", "assistant"]), text))
        kids = {}
        for t in range(n):
            kids.setdefault(parent.get(t), []).append(t)
        for r in kids[None]:
            at, stack = 0, [r]
            while stack:
                x = stack.pop()
                expected[c, x] = (parent.get(x), r, at, " ".join(own[x]))
                at += 1
                stack += reversed(kids.get(x, []))
    return rows, expected


def test_conversations_come_in_reply_order(spark):
    rows, expected = reply_fixture()
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, thread int")
    got = format_conversations(df).collect()
    assert {(r.conv_id, r.turn): (r.reply_turn, r.thread, r.position, r.body) for r in got} == expected
    odd = spark.createDataFrame(
        [(1, 0, "user", "Hi there all."), (1, 0, "user", "Hi there all."), (1, 1, None, "> Hi there\n> all.\nYes."), (None, 3, "user", "> nobody said\nx"), (2, 0, "user", "> hi there all.\nMe too."), (3, 0, "user", None)],
        "conv_id long, turn long, role string, text string",
    )
    out = format_conversations(odd).collect()
    assert len(out) == 6
    found = {(r.conv_id, r.turn): r for r in out}
    assert (found[1, 1].reply_turn, found[1, 1].position, found[1, 1].body) == (0, 1, "Yes.")
    assert (found[2, 0].reply_conv, found[2, 0].reply_turn, found[2, 0].thread, found[2, 0].position) == (1, 0, 0, 0)
    assert found[3, 0].body == "" and found[None, 3].body == "x" and found[None, 3].n_quotes == 1
    assert format_conversations(odd.limit(0)).count() == 0


def test_nested_quotes_are_parsed():
    assert parse("A wrote:\n> one\n> two\n>> deep\n> back\nown\n\nB writes:\n> other") == ("own", [(1, "one\ntwo"), (2, "deep"), (1, "back"), (1, "other")])


def test_pipeline_rejects_what_only_a_few_documents_show(spark):
    df, rare = unlike_any_of_a_few_thousand(spark)
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, df, "").select("doc_id").collect()}
    assert not kept & rare and len(kept & set(range(4500))) >= 0.99 * 4500


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    item = " ".join(rng.choice(WORDS) for _ in range(20))
    clean = [prose(rng, 15) for _ in range(80)]
    near = clean[3].split()
    near[40] = "other"
    texts = [*clean, *[junk(rng, k) for k in range(24)], clean[0], " ".join(near), f"{clean[5]} extra {prose(rng, 6)} {item}", prose(rng, 10) + ' password = "q8Zr5TtW1" end.', None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {k: t for k, t in enumerate(clean)} | {107: texts[107][: texts[107].index("password")] + '[SECRET]" end.'}
    assert {i: r.ids for i, r in got.items()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in expected.items()}


#: Names that the operators use themselves, as further columns of the documents.
CLASHING = "score keep posterior votes spans kinds starts ends row node key label n_shingles component_id similarity item_id place changed c0 c1".split()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_documents_of_any_shape(spark, stage, tmp_path):
    """Clashing columns, nulls in every column, repeated rows, very long texts, empty tables; null ids stay."""
    spark.createDataFrame([(0, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain, rng = "Some plain words stand here. They are fine.", random.Random(1)
    long = " ".join(f"{rng.choice(WORDS)}{'.' if k % 9 == 8 else ''}" for k in range(30_000))
    rows = [(1, plain), (1, plain), (None, plain + " More of it."), (2, None), (3, ""), (4, long)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in [*CLASHING, "a.b"])
    docs = spark.createDataFrame([(i, t, *[None] * 2, len(t or ""), *[f"v{c}" for c in CLASHING], None) for i, t in rows], kind)
    out = stage[1](spark, docs, str(tmp_path))
    kept = out.collect()
    if stage is corpus_pipeline.STAGES[-1]:
        assert len(kept) == 6
    else:
        assert out.columns == docs.columns and all(r["score"] == "vscore" and r["c1"] == "vc1" for r in kept)
        assert {r.doc_id for r in kept} >= {1, None, 4} and sum(r.doc_id == 1 for r in kept) == 2
        assert {r.text for r in kept if r.doc_id == 4} == {long}
    assert stage[1](spark, docs.limit(0), str(tmp_path)).count() == 0
