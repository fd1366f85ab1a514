import hashlib
import zlib

import llm_brute as brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import BASE
from pyspark.sql import functions as F

from chunkwise.llm import bpe, decontaminate, html, jaccard, langid, linededup, quality, queries, quotes, repeats, tokenids
from chunkwise.llm.components import components

VOCABULARY = queries.tokenizer_path()


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.select(*names).collect()]


def by(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


# token files


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70000), st.integers(0, 2**32 - 1)), max_size=50))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(values):
    values = np.array(values, np.uint32)
    assert (tokenids.unpack(*tokenids.pack(values), len(values)) == values).all()


def test_token_files(spark, odd, none, library):
    got = by(rows_of(tokenids.token_digest(odd, VOCABULARY, 2), "doc_id", "start", "n_tokens", "ids_crc32"))
    at, want = 0, []
    key = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("x"))
    for d, t, _ in sorted(rows_of(key, "doc_id", "text", "x"), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    null = [w for w in want if w[0] is None]
    assert len(null) == 2
    assert by(x[0:1] + x[2:] for x in got) == by(x[0:1] + x[2:] for x in want)
    assert by(x for x in got if x[0] is not None) == by(x for x in want if x[0] is not None)
    assert tokenids.token_digest(none, VOCABULARY, 2).count() == 0


# byte-pair encoding


def test_bpe_equals_library(odd, none, library):
    texts = rows_of(odd, "doc_id", "text")
    got = by(rows_of(bpe.encode_decode(odd, VOCABULARY, with_ids=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"))
    want = []
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == by(want)
    assert bpe.encode_decode(none, VOCABULARY).count() == 0


@given(st.lists(st.text(alphabet="abAB é'0.,<|>ś漢Σ !9", max_size=30), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_words_alone_give_the_text(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for memory in (bpe._memory(VOCABULARY)[1], tokenids.word_tokenizer(VOCABULARY)):
        memory.clear()
        words = memory.words(np.frombuffer(data, np.uint8), offsets)
        memory.flush()
        ids, counts = memory.texts(*words)
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == want


def test_merges_overlap_from_the_left():
    merger = bpe.PairMerger(np.arange(256), np.arange(256), np.array([[97, 97, 256], [256, 256, 257]]), 258)
    symbols, counts = merger([b"aaaaa", b"", b"aa", b"aaa"])
    assert symbols.tolist() == [257, 97, 256, 256, 97] and counts.tolist() == [2, 0, 1, 2]


# language


def test_languages(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    prototypes = langid.learn_languages(docs, ~held)
    assert set(prototypes) == {"de", "en", "es", "fr"}
    found = langid.predict_languages(docs, prototypes).join(docs.where(held).select("doc_id", "lang"), "doc_id")
    good, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and good >= 0.97
    result = rows_of(langid.predict_languages(odd, prototypes), "doc_id", "lang_pred", "score")
    assert len(result) == odd.count() and all(0 <= s <= 1 for *_, s in result)
    assert {p for d, p, _ in result if d in (4, 5, 6)} == {"und"}
    assert langid.predict_languages(none, prototypes).count() == 0
    assert {r[0] for r in rows_of(langid.predict_languages(odd, langid.learn_languages(none, F.lit(True))), "lang_pred")} == {"und"}


def test_language_query_against_brute_force(spark, tmp_path, sf_dir, odd):
    """All rows of the query: the tables' texts and odd ones, whose languages are in part null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    more = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", "lang")
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute.languages(rows_of(docs.unionByName(more), "doc_id", "text", "lang"), langid.letter_vector)
    got = {d: x for d, *x in rows_of(queries.op2_language_id(spark, str(tmp_path)), "doc_id", "held_out", "lang_pred", "score")}
    assert set(got) == set(want)
    for d, (held, lang, score) in want.items():
        assert got[d][:2] == [held, lang] and got[d][2] == pytest.approx(score, abs=1e-5), d


def test_bundle_is_the_sum_of_bound_vectors():
    text = "Añb c"
    data = np.frombuffer(text.encode(), np.uint8)
    grams, bounds = langid.text_grams(data, np.array([0, len(data)]))
    letters = [(0, "a", "ñ"), ("a", "ñ", "b"), ("ñ", "b", 0), (0, "c", 0)]
    code = [[ord(x) if x else 0 for x in g] for g in letters]
    assert sorted(grams.tolist()) == sorted((a << 42) | (b << 21) | c for a, b, c in code) and bounds.tolist() == [0, 4]
    want = sum(np.roll(langid.letter_vector(a), 2) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c) for a, b, c in code)
    assert (langid.GramVectors().bundle(*np.unique(grams, return_counts=True)) == want).all()


# Jaccard join


def test_jaccard_join(odd, none):
    got = rows_of(jaccard.jaccard_components(odd), "doc_id", "n_shingles", "component_id")
    assert by(got) == by(brute.jaccard_components(rows_of(odd, "doc_id", "text")))
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_join_of_a_null_id_before_its_copies(spark):
    near = BASE.replace("gamma30.", "delta")
    rows = [(None, BASE), (2, BASE), (1, near), (3, BASE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = rows_of(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id")
    assert {c for d, _, c in got if d is not None} == {1}
    assert by(got) == by(brute.jaccard_components(rows))


def test_jaccard_join_of_chains_and_groups(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(0, 60)]  # each near its neighbours only
    rows += [(1000 + i, " ".join(words[:100]) + f" z{i}") for i in range(40)]  # one large group
    rows += [(2000 + i, f"q{i} " + " ".join(words[100:150]) + f" q{i}" * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    old, jaccard.GROUP, jaccard.QUERIES = (jaccard.GROUP, jaccard.QUERIES), 4, 3
    try:
        got = rows_of(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id")
    finally:
        jaccard.GROUP, jaccard.QUERIES = old
    assert by(got) == by(brute.jaccard_components(rows))


def test_jaccard_join_of_a_size_between_the_extremes(spark):
    """Sizes 21 and 24 share one prefix token at least, more with 21 and 25; the group has all three."""
    passage, own = [f"p{i}" for i in range(24)], [f"x{i}" for i in range(4)]
    texts = {1: [*own, *passage[:21]], 2: [*own, *passage], 3: ["y", *own, *passage], 4: ["q", *passage]}
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    for i in range(9):  # the passage is frequent elsewhere, its end most of all
        rows.append((100 + i, " ".join([*(f"f{i}_{k}" for k in range(100)), *(passage if i < 6 else passage[17:])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id")
    assert {c for d, _, c in got if d < 100} == {1}
    assert by(got) == by(brute.jaccard_components(rows))


@pytest.mark.parametrize("threshold", [50, 80, 93])
def test_least_share_is_the_least_of_all_sizes(spark, threshold):
    sizes = [(n, a, a + w) for n in (1, 5, 21, 64, 333) for a in (max(1, n * threshold // 100), n, n + 3) for w in (0, 1, 4, 9, n)]
    df = spark.createDataFrame(sizes, "n long, least long, most long")
    every = df.withColumn("m", F.explode(F.sequence("least", "most"))).groupBy("n", "least", "most").agg(F.min(jaccard._share(F.col("n"), F.col("m"), threshold)).alias("s"))
    assert by(rows_of(df.distinct().withColumn("s", jaccard._least_share("n", "least", "most", threshold)), "n", "least", "most", "s")) == by(rows_of(every, "n", "least", "most", "s"))


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99), (99, 100), (7, 7)], "u long, v long")
    assert dict(components(path).collect()) == {i: 0 for i in range(1, 51)} | {100: 99}


# repeated substrings


@pytest.mark.parametrize("crowd", [256, 1])
def test_repeats(odd, none, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    got = rows_of(repeats.without_repeats(odd, with_text=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    want = brute.repeats(rows_of(odd, "doc_id", "text"))
    assert by(tuple(x[:4]) + (bytes(x[4]),) for x in got) == by(want)
    assert all(hashlib.sha256(x[4]).hexdigest() == x[5] for x in got)
    assert repeats.without_repeats(none).count() == 0


def test_interval_tree_finds_all_repeats():
    random = np.random.default_rng(3)
    for _ in range(40):
        size = int(random.integers(2, 9))
        lefts, rights = ([bytes(random.choice([97, 97, 98], int(random.integers(0, 6))).tolist()) for _ in range(size)] for _ in range(2))
        need = int(random.integers(1, 7))
        got = {}
        for members, d, left in repeats.repeat_groups(lefts, rights, need):
            for m, n in zip(members, left):
                b, a = got.get(m, (-1, -1))
                got[m] = (max(b, n), max(a, d))
        shared = repeats._shared_prefix
        want = {}
        for i in range(size):
            pairs = [(shared(lefts[i], lefts[j]), shared(rights[i], rights[j])) for j in range(size) if j != i]
            pairs = [p for p in pairs if sum(p) >= need]
            if pairs:
                want[i] = (max(p[0] for p in pairs), max(p[1] for p in pairs))
        assert got == want


# quality


def test_letter_grams_are_of_characters():
    texts = ["Añ漢b", "", "é", "añ漢b😀"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    grams = quality.Grams(np.frombuffer(data, np.uint8), offsets)
    odd = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
    want = []
    for t in texts:
        c = [ord(x) for x in t]
        three = [a | b << 21 | d << 42 for a, b, d in zip(c, c[1:], c[2:])]
        four = [x * 0x9E3779B97F4A7C15 + d for x, d in zip(three, c[3:])]
        want.append(sorted([(x * m % 2**64 >> 48) + quality.BUCKETS for g, m in zip((three, four), odd) for x in g]))
    got = [sorted(int(b) for b in index if b >= quality.BUCKETS) for index, _ in grams.features()]
    assert got == [sorted(set(w)) for w in want]


def test_quality_probability_of_all_rows(spark, sf_dir, odd):
    """The whole result of the rules against a plain walk over words and characters."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    texts = [r["text"] for r in docs.limit(60).collect()] + [t for (t,) in rows_of(odd, "text")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for d, p, failed, kept in rows_of(quality.quality_rules(df, model), "doc_id", "probability", "base_failed", "kept"):
        data = (texts[d] or "").encode()
        z = model.bias
        for index, share in quality.Grams(np.frombuffer(data, np.uint8), np.array([0, len(data)])).features():
            z += sum(quality.SCALE * float(s) * float((model.words if b < quality.BUCKETS else model.letters)[b % quality.BUCKETS]) for b, s in zip(index.tolist(), share.tolist()))
        assert p == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30))), abs=1e-4)
        assert kept == (not failed and p >= quality.KEEP_AT)


def test_quality_fit_is_bounded_in_bytes(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert quality.fit_quality(docs, labels, most_bytes=0).words is None
    assert quality.fit_quality(docs, labels, most_bytes=200_000).words is not None


def test_quality_counts(odd, none):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = rows_of(quality.quality_rules(odd, quality.QualityModel()), "doc_id", *names, "base_failed", "kept")
    want = [(d, *(c := brute.base_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for d, t in rows_of(odd, "doc_id", "text")]
    assert by(got) == by((*w, not w[-1]) for w in want)
    assert quality.quality_rules(none, quality.QualityModel()).count() == 0


def test_quality_model(spark, sf_dir, odd, none):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_rules(docs, quality.fit_quality(docs, labels)).where("not base_failed").join(labels, "doc_id")
    accuracy, n = found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double")), F.count("*")).first()
    assert n > 30 and accuracy > 0.9
    assert quality.fit_quality(docs, labels.limit(0)).words is None
    bad = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    assert quality.fit_quality(odd, bad).words is None
    kept = quality.keep_good(odd, quality.QualityModel())
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()


# decontamination


def test_contained_items(spark, odd, none):
    items = [(1, BASE[10:400]), (2, "One TWO"), (3, None), (4, ""), (None, BASE), (5, "nothing like this at all here"), (1, BASE[10:400]), (6, BASE + " and some more words here")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contained(rows_of(odd, "doc_id", "text"), items)
    names = ("doc_id", "item_id", "n_item_shingles", "n_shared")
    assert len(want) > 5
    for most in (decontaminate.MOST_SENT, 0):
        assert by(rows_of(decontaminate.contaminated(odd, frame, most_sent=most), *names)) == by(want)
    assert decontaminate.contaminated(none, frame).count() == 0 == decontaminate.contaminated(odd, frame.limit(0)).count()
    clean = decontaminate.without_contaminated(odd, frame)
    assert clean.columns == odd.columns
    assert by(rows_of(clean, "doc_id")) == by((d,) for d, in rows_of(odd, "doc_id") if d not in {w[0] for w in want})


# lines


@pytest.mark.parametrize("near", [linededup.NEAR, 5.0])
def test_line_dedup(spark, none, monkeypatch, near):
    monkeypatch.setattr(linededup, "NEAR", near)  # 5.0: every line is near the threshold
    monkeypatch.setattr(linededup, "MOST_ROWS", 200_000 if near < 1 else 0)  # 0: all joins by shuffle, salted
    shared, rare = "This very line is everywhere on sites.", "This line is on two sites only, it stays."
    rows = [(i, f"{shared}\nown line number {i} of its document\n  {shared} \nok\n{rare if i < 2 else ''}", f"s{i % 5}") for i in range(12)]
    rows += [(None, shared + "\nlast", "s9"), (20, None, "s1"), (21, "", None), (22, shared, None), (22, shared, None), (-(1 << 63), shared, "s1"), (23, "ok\n" * 30000 + "end", "s2")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, row int").withColumn("gone", F.lit("mine"))
    got = rows_of(linededup.line_report(df, min_sites=4), "doc_id", "n_lines", "kept_sha256")
    want = brute.boilerplate(rows, 4)
    assert by(got) == by((d, n, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for d, n, t in want)
    changed = linededup.without_boilerplate(df, min_sites=4)
    assert changed.columns == df.columns and by(rows_of(changed, "doc_id", "text")) == by((d, t) for d, _, t in want)
    assert linededup.line_report(none).count() == 0


# quotations


def test_quotations(spark):
    rows = [
        (1, 0, "user", "First question here\nwith two lines"),
        (1, 1, "assistant", "On Monday, A wrote:\n> First question here\n> with two lines\nAn answer."),
        (1, 2, "user", "> > First  question here\n> an ANSWER.\n\nThanks a lot"),
        (1, 3, "user", "> nobody said this\nStill here"),
        (1, 4, "assistant", None),
        (2, 0, "user", "> First question here\nother conversation"),
        (None, 0, "user", "null conversation"),
        (None, None, None, "> null conversation\nreply"),
        (1, 1, "assistant", "On Monday, A wrote:\n> First question here\n> with two lines\nAn answer."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, lines string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    assert quotes.link_quotes(df).count() == len(rows)
    assert [got[1, t]["parent_turn"] for t in range(5)] == [None, 0, 1, None, None]
    assert [got[1, t]["reply"] for t in range(5)] == ["First question here\nwith two lines", "An answer.", "Thanks a lot", "Still here", ""]
    assert [got[1, t]["depth"] for t in range(5)] == [0, 1, 2, 0, 0]
    assert got[1, 2]["path"] == "00000000/00000001/00000002" and got[1, 1]["n_quoted"] == 2 and got[1, 1]["n_linked"] == 2
    assert got[2, 0]["parent_turn"] is None and got[2, 0]["n_quoted"] == 1
    assert got[None, None]["path"] == "null" and got[None, 0]["path"] == "00000000"
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_nested_quotations(spark):
    rows = [
        (1, 0, "The first words"),
        (1, 1, "> The first words\nAn answer to them"),
        (1, 2, "> > The first words\n> An answer, edited\nMore"),
        (1, 3, ">>> the first  words\nDeeper"),
        (1, 4, "> > An answer to them\nNot quoted one level up before"),
        (1, 5, ">> An answer to them\n>> The first words\n> More\n> Deeper\nBoth levels"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in quotes.link_quotes(df).collect()}
    assert [got[t]["parent_turn"] for t in range(6)] == [None, 0, 1, 2, None, 3]
    assert [got[t]["n_linked"] for t in range(6)] == [0, 1, 1, 1, 0, 3]
    assert [got[t]["depth"] for t in range(6)] == [0, 1, 2, 3, 0, 4]


def test_passages_are_linked_as_a_whole(spark):
    long = "\n".join(f"line {i} of a long message" for i in range(20000))
    rows = [
        (1, 0, "one two"),
        (1, 1, "three four"),
        (1, 2, "One two\nthree  four\n\nand more"),
        (1, 3, "> one two three\n> four\nThe passage, wrapped anew"),
        (1, 4, "> one two\n> three four\nThe passage, whole"),
        (1, 5, "> three four\n> something else\nA mixed one"),
        (1, 6, long),
        (1, 7, "\n".join("> " + x for x in long.split("\n")) + "\nAll of it"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in quotes.link_quotes(df).collect()}
    assert [got[t]["parent_turn"] for t in range(8)] == [None, None, None, 2, 2, 1, None, 6]
    assert [got[t]["n_linked"] for t in (3, 4, 5, 7)] == [2, 2, 1, 20000] and got[7]["reply"] == "All of it"


def test_quotations_match_sql(spark, tmp_path):
    import duckdb

    said = [f"line {i} of the talk" for i in range(6)]
    rows = []
    for c in range(12):
        for t in range(6):
            quoted = [said[(c + t + k) % 6] for k in range(t % 3)]
            again = [f"> {x}" for x in rows[-1][3].split("\n")] if t == 5 or c % 3 == t % 3 == 1 else []
            rows.append((c, t, "user", "\n".join([*again, *[f"{'> ' * (1 + k % 2)}{x}" for k, x in enumerate(quoted)], said[(c * t) % 6], f"own {c} {t}"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(queries.ORACLE["op7_quotation_links"])
    names = want.columns
    assert any(r[names.index("depth")] > 1 for r in want.fetchall())
    assert by(rows_of(quotes.link_quotes(df), *names)) == by(want.fetchall())


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>not text</p>";</script></head><body class="page">
<header>Site of the day <a href=/>home</a></header><nav><ul><li><a href=/a>The way to the top of it</a></ul></nav>
<div class="cookie-notice">We use the cookies of this and that for you to be happy with it and us, as it is the law of the land.</div>
<main><h1>Of the sea &amp; the land</h1><!-- <p>the hidden</p> --><p>It was <b>the</b> best of the times and it was the worst of them, as it is said in the book of the year.</p><p>Short &eacute;nd.</p>
<form>Sign up for the news of the day and all of the offers that we have for you and for your friends in the town.</form>
<p>And so it was that the ship of the king came to the shore in the night with all of its men and\n  women\n<br>aboard.
<div id="comments"><p>I think that this is the best of the articles that I have read on the site in the year so far.</p></div></main>
<aside>For the fans of the sea: a list of the best books on it, and where it is that you can have them from us.</aside>
<footer>&copy; the owner of the site and all of the rights in it, which are with the owner of the site.</footer>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<p>tiny"), (5, "x", "just the text of a page without any of the tags that it should have, as it is in the file of the year"), (1, "u", PAGE), (6, "y", "<article><p>a < b &lt; c <script>"), (7, "z", "<article>" + "<div><p>the of and " * 3000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract_text(df).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == "Of the sea & the land It was the best of the times and it was the worst of them, as it is said in the book of the year. Short énd. And so it was that the ship of the king came to the shore in the night with all of its men and women aboard."
    assert texts[2] == texts[None] == texts[4] == "" and texts[5].startswith("just the text") and texts[6] == "a < b < c"
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got) and html.extract_text(df.limit(0)).count() == 0


def test_html_of_broken_and_very_long_pages():
    story = "It was the best of the times and it was the worst of them, as it is said in the book of the year."
    assert html.main_text(f"<article><div class=entry-header><h2>A title</h2></div><p>{story}</p><div class=related>Read this too</div></article>") == f"A title {story}"
    assert html.main_text(f"<article><p>{story}</p><p>{story} <b 'c</p>") == f"{story} {story}"
    for page in ("<a " * 50_000, "<!" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, '<a "' * 50_001 + "<p>" * 1000, "<script " * 20_000):
        html.main_text(page)
    assert len(html.main_text("<article>" + f"<p>tiny</p><p>{story}</p>" * 20_000)) == 20_000 * (len(story) + 6) - 1


def test_html_of_all_pages(spark, sf_dir):
    import re
    from html import unescape

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        assert html.main_text(r["html"]) == " ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())


def test_crowded_passages(spark, monkeypatch):
    """Passages a little shorter and longer than a window in many documents, with and without equal surroundings."""
    monkeypatch.setattr(repeats, "CROWD", 2)
    random = np.random.default_rng(11)
    text = lambda n: "".join(random.choice(list("abcdefgh ij"), n))
    passages = [text(n) for n in (360, 395, 399, 400, 401, 430, 700)]
    rows = []
    for i in range(60):
        near = passages[i % 7]
        rows.append((i, text(int(random.integers(0, 300))) + near[int(random.integers(0, 30)) if i % 5 == 0 else 0 :] + text(int(random.integers(0, 300)))))
    rows += [(100 + i, passages[6][:380] + text(30) + passages[6][390:]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(repeats.without_repeats(df, with_text=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert by(tuple(x[:4]) + (bytes(x[4]),) for x in got) == by(brute.repeats(rows))
