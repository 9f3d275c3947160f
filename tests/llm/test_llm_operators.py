"""Every operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import gc
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import bpe, chat, decontamination, idfile, lines, neardup, pii, queries, repetition, tokencount, units, wrappers

SF_DIR = "/root/testdata/sf0.001"
GPT = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 3
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "word", "b"), (5, COPY, "a"), (6, COPY, "b"), (6, COPY, "b"), (None, "no id here", "c"),
    (7, "x" * 5000, "a"), (8, "Line one\nLine one\nß日本 <|endoftext|> 's'S  two  spaces\r\n", "c"), (9, ("long text. " * 3000) + "end", "a"),
    (10, "mail a.b@c.de, +1 (555) 010-9999 or 4111 1111 1111 1111 and 10.0.0.256 10.0.0.25", "d"), (11, COPY.upper() + "more", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "fr", k) for k, (i, t, s) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def split_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    results = [
        repetition.judge(empty), lines.remove_boilerplate(empty), neardup.mark(empty), neardup.keep_one(empty), decontamination.find_leaks(empty, bench),
        bpe.encode_texts(empty, MULTI, public_tokenizers.PATTERN), tokencount.count_tokens(empty, GPT), pii.sanitise(empty), wrappers.extract(pages),
    ]
    assert [x.count() for x in results] == [0] * len(results)


def test_no_items(spark, docs):
    bench = spark.createDataFrame([(None, None), (1, ""), (2, " ,. ")], "item_id long, text string")
    assert decontamination.find_leaks(docs, bench).where("contaminated").count() == 0
    assert decontamination.drop_leaks(docs, bench).count() == len(ROWS)


# --- 8: repetition ----------------------------------------------------------


def repeats(words, size):
    at = {}
    for i in range(len(words) - size + 1):
        at.setdefault(tuple(words[i : i + size]), []).append(i)
    hit = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(size)}
    longest = max((n for n in range(size, len(words)) if any(words[i : i + n] == words[j : j + n] for i in range(len(words) - n + 1) for j in range(i))), default=0)
    return len(hit), longest


def test_repetition_brute_force():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.randrange(30))) for k in range(120)]
    for size in (1, 3, 8):
        words, covered, longest = repetition.repetition(texts, size)
        for k, t in enumerate(texts):
            assert (words[k], covered[k], longest[k]) == (len(t.split()), *repeats(t.split(), size)), (size, t)


def test_judge(docs):
    found = repetition.judge(docs).collect()
    assert len(found) == len(ROWS)
    for r, (i, t, _) in zip(found, ROWS, strict=True):
        own = split_words(t)
        full = [x for x in (t or "").split("\n") if split_words(x)]
        assert (r.doc_id, r.n_words, r.word_chars) == (i, len(own), sum(map(len, own)))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)))
        assert r.base_failed == (len(own) < 20 or 100 * r.n_repeat_words > 30 * len(own))
        assert not (r.kept and r.base_failed)
    assert repetition.keep_good(docs).columns == docs.columns


# --- 4: near-duplicates -----------------------------------------------------


def brute_components(rows, words=4):
    sets = []
    for _, t, *_ in rows:
        w = split_words(lower(t))
        size = min(words, len(w))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if size else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return sorted((rows[k][0], len(sets[k]), min(rows[m][0] for m in range(len(rows)) if group[m] == group[k])) for k in range(len(rows)))


def near_copies():
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for k in range(60):  # a chain: neighbours are alike, the ends are not
        base[(7 * k) % 200] = f"x{k}"
        rows.append((100 + k, " ".join(base)))
    rows += [(300 + k, " ".join(f"y{rng.randrange(9000)}" for _ in range(80))) for k in range(20)]
    return rows + rows[:5] + [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d"), (6, "a b c")]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_near_duplicates(spark, limit, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = neardup.components(df, rule=queries.FOUR_WORDS, broadcast_ids=limit).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)
    kept = neardup.keep_one(df, rule=queries.FOUR_WORDS).collect()
    expected = sorted({i for i, _, low in brute_components(rows) if i == low})
    assert sorted(r.doc_id for r in kept) == expected


def test_index_finds_all_pairs_within_distance():
    rule, rng = neardup.Similar(), np.random.default_rng(2)
    one = rng.integers(0, 65_536, (200, rule.values())).astype(np.uint16)
    two = one.copy()
    for k in range(200):
        two[k, rng.choice(rule.values(), rule.chunks * (rule.errors + 1) - 1, replace=False)] += 1
    assert (neardup.chunk_keys(one, rule) == neardup.chunk_keys(two, rule)).any(axis=1).all()


# --- 6: decontamination -----------------------------------------------------


@pytest.mark.parametrize("block", [500_000, 2])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "A,b;C"]
    items = [(k, " ".join(rng.choice("abcd") for _ in range(n))) for k, n in enumerate((3, 10, 12, 0, 4, 11))] + [(9, None), (1, "a b c d d d d")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    tokens = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    for r in decontamination.find_leaks(df, bench).collect():
        own, hit, named = tokens(texts[r.doc_id]), set(), set()
        for item, t in items:
            w = tokens(t)
            size = min(10, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                for j in range(len(own) - size + 1):
                    if own[j : j + size] == w[i : i + size]:
                        hit |= set(range(j, j + size))
                        named.add(str(item))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(own), len(hit), len(named), digest, bool(hit))
    clean = {r.doc_id for r in decontamination.find_leaks(df, bench).where("NOT contaminated").collect()}
    assert {r.doc_id for r in decontamination.drop_leaks(df, bench).collect()} == clean


# --- 7: line dedup ----------------------------------------------------------


def test_lines(spark, docs):
    rows = [(k, f"own line {k} that is long enough to stay\nshared footer\n\n", f"s{k % 14}") for k in range(30)]
    rows += [(100 + k, f"own line {k}, long enough\nfew sites", f"s{k % 9}") for k in range(30)] + [(200, None, None), (201, "shared footer", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (500_000, 0):
        found = {r.doc_id: r for r in lines.remove_boilerplate(df, broadcast_lines=limit).collect()}
        assert found[0].text == "own line 0 that is long enough to stay\n\n" and found[0].n_removed == 1
        assert "few sites" in found[100].text and found[200].text is None
        assert found[201].text == "shared footer"  # nothing but boilerplate: a copy, left whole
    assert lines.remove_boilerplate(docs).count() == len(ROWS)


def test_extra_columns_with_clashing_names_stay(spark):
    rows = [(k, f"own line {k}\nshared footer" if k % 5 else "shared footer\nown", f"s{k}", k, "key", "drops", "own", "id", "gone", "place") for k in range(15)]
    names = ["doc_id", "text", "source", "n_lines", "text_key", "line_drops", "line_text_key", "gone_id", "gone_key", "place"]
    df = spark.createDataFrame(rows + rows[:1], names)
    df = df.selectExpr("*", "'k' AS set_key", "1 AS N_REMOVED", "'c' AS component_id")
    for limit in (500_000, 0):
        cleaned = lines.remove_boilerplate(df, broadcast_lines=limit)
        assert cleaned.columns == [*df.columns, "n_lines_", "n_removed_"]
        assert {(r.n_lines, r.text_key, r.n_lines_, r.n_removed_) for r in cleaned.collect()} == {(k, "key", 2, 1) for k in range(15)}
        assert lines.remove_boilerplate(df, broadcast_lines=limit, counts=False).schema == df.schema
    kept = neardup.keep_one(df, rule=neardup.Similar(words=1))
    assert kept.columns == df.columns and len(kept.collect()) == len(neardup.mark(df, rule=neardup.Similar(words=1)).where("kept").select("doc_id").distinct().collect())
    staged = corpus_pipeline.line_dedup(spark, df.withColumn("n_chars", F.length("text")), SF_DIR)
    assert staged.columns == [*df.columns, "n_chars"] and all(r.n_lines == r.doc_id and r.n_chars == len(r.text) for r in staged.collect())


def test_mostly_shared_texts_lose_their_shared_lines(spark):
    notice = "a long notice that all the sites of this table carry " * 4
    rows = [(k, f"own {k}\n{notice}\n", f"s{k}") for k in range(12)] + [(50, f"{notice}\n \n{notice}", "s1"), (51, "x\n" + f"{notice}\n" * 9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = {k: f"own {k}\n" for k in range(12)} | {50: f"{notice}\n \n{notice}", 51: "x\n"}
    for limit in (500_000, 0):
        assert {r.doc_id: r.text for r in lines.remove_boilerplate(df, broadcast_lines=limit).collect()} == expected
    stage = corpus_pipeline.line_dedup(spark, df, SF_DIR)
    assert {r.doc_id: r.text for r in stage.collect()} == expected


# --- 5, 9, 10: tokens -------------------------------------------------------


def test_bpe(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for limit in (8_000_000, 0):
        found = bpe.encode_texts(docs, MULTI, public_tokenizers.PATTERN, broadcast_words=limit).collect()
        expected = []
        for i, t, _ in ROWS:
            ids = own.encode_ordinary(t or "")
            expected.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(expected)


def test_long_words_merge_like_the_library(spark):
    ranks = bpe.read_ranks(MULTI)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    words = ["".join(rng.choice(part) for _ in range(n)) for part in ("abcdefgh", "aab", "日本語のテスト", "é") for n in (1, 2, 9, 40, 700)]
    for word in words:
        assert bpe.merge_long(word.encode(), ranks) == own.encode_ordinary(word)
    df = spark.createDataFrame([(w.encode(),) for w in words], "word binary")
    for limit in (0, 8, 100_000):  # all by heap, some, all by fold
        short = df.where("octet_length(word) < 400") if limit > 99 else df
        for r in bpe.encode_words(short, ranks, limit).collect():
            assert r.x.ids == own.encode_ordinary(bytes(r.word).decode()) and r.x.decoded == r.word


def test_a_megabyte_without_spaces(spark):
    ranks = bpe.read_ranks(MULTI)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = base64.b64encode(random.Random(1).randbytes(750_000)).decode().replace("+", "x").replace("/", "y")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = bpe.encode_texts(df, MULTI, public_tokenizers.PATTERN).collect()
    ids = own.encode_ordinary(text)
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_cut_pieces_have_the_same_ids():
    library, rng = units.load(open(GPT, "rb").read()), random.Random(4)
    parts = [" ", "\n", "\t", "a", "b.", "1é", "日", "<|endoftext|>", "'s", "\r", "\x00", "\xa0", " ", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)]
    expected = [e.ids for e in library.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in library.packed(texts)] == expected


def test_latin_pieces_are_encoded_by_their_words(monkeypatch):
    """Words that end differently are merged once, without the library's search for the pattern, and have the same ids."""
    library, rng = units.Library(open(GPT, "rb").read()), random.Random(5)
    parts = ["word", "Öl", "ÿ", "ɏ", "don't", "'S", "''ll", "42", "+", "...", "$$", "<|", "x", "~", "\x7f", "×", "²", " ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(1500)] + ["x<|endoftext|>y", "a <|endoftext|>"]
    expected = [e.ids for e in library.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in library.packed(texts)] == expected
    asked, encode = [], units.Library.encode
    monkeypatch.setattr(units.Library, "encode", lambda self, texts: asked.extend(texts) or encode(self, texts))
    library.packed(["Größe, größe. it's (größe) größe42"])
    assert asked == []
    library.packed(["x<|endoftext|>z", "日本"])
    assert len(asked) > 0


def test_bpe_table_goes_out_in_parts(spark, monkeypatch):
    """The driver holds a bounded part of the table of words at once."""
    monkeypatch.setattr(bpe, "_SENT_BYTES", 100)
    ranks = bpe.read_ranks(MULTI)
    words = spark.createDataFrame([(f"word{i}".encode(),) for i in range(400)], "word binary").repartition(7)
    sent, odd = bpe._sent(bpe.encode_words(words, ranks).select("word", "x.ids", "x.decoded"))
    assert len(sent) > 1 and odd.value == {}
    wanted = [f"word{i}".encode() for i in (3, 399, 40)]
    assert bpe._find([x.value for x in sent], odd.value, wanted) == [(",".join(map(str, bpe.merge_long(w, ranks))), w) for w in wanted]
    with pytest.raises(LookupError):
        bpe._find([x.value for x in sent], odd.value, [b"word3", b"word400"])


def test_bpe_words_beyond_the_table_move_no_rows(docs):
    """Rows stay in their tasks however many words there are; words that the table leaves out have the ids of the fold."""
    whole = bpe.encode_texts(docs, MULTI, public_tokenizers.PATTERN)
    words = bpe.distinct_words(docs, "text", public_tokenizers.PATTERN).count()
    expected = sorted(map(str, whole.collect()))
    for limit in (words - 1, 0):
        found = bpe.encode_texts(docs, MULTI, public_tokenizers.PATTERN, broadcast_words=limit)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert sorted(map(str, found.collect())) == expected


def test_pipeline_encodes_words_beyond_the_table_in_place(spark, docs, monkeypatch):
    """The last stage moves no rows, however many words its documents have."""
    whole = sorted(map(str, corpus_pipeline.encode(spark, docs, SF_DIR).collect()))
    *others, _ = bpe.encode_texts.__defaults__
    monkeypatch.setattr(bpe.encode_texts, "__defaults__", (*others, 3))
    found = corpus_pipeline.encode(spark, docs, SF_DIR)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert sorted(map(str, found.collect())) == whole


def test_words_outside_the_table_merge_like_the_library():
    ranks, rng = bpe.read_ranks(MULTI), random.Random(7)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for part in ("abcdefgh", "aab", "日本語のテスト", "é", " the"):
        for n in (1, 2, 3, 9, 40, 300):
            word = "".join(rng.choice(part) for _ in range(n))
            assert bpe.merge_word(word.encode(), ranks) == bpe.merge_long(word.encode(), ranks) == own._encode_single_piece(word)


def test_bpe_table_has_the_words_of_the_most_tasks(spark):
    rows = [(b"a", 9), (b"b", 9), (b"c", 4), (b"dd", 4), (b"e", 1), (b"f", 1), (b"gg", 1)]
    words = spark.createDataFrame(rows, "word binary, n long")
    chosen = lambda limit, **more: sorted(bytes(r.word) for r in bpe.table_words(words, limit, **more).collect())
    assert chosen(7) == chosen(100) == [w for w, _ in rows]
    assert chosen(6) == chosen(4) == [b"a", b"b", b"c", b"dd"]
    assert chosen(3) == [b"a", b"b"] and chosen(1) == chosen(0) == []
    # Words of one hash can't be told apart in the table, and one that is left out may have the hash of one in it.
    assert chosen(4, key=F.octet_length("word")) == []
    assert chosen(4, key=F.when(F.col("word").isin(b"c", b"f"), F.lit(b"c")).otherwise(F.col("word"))) == [b"a", b"b", b"dd"]


def test_bpe_odd_words_outside_the_table(spark, tmp_path):
    """Pieces of one rank decode to the last of them, whether a word is in the table or not."""
    pieces = [bytes([i]) for i in range(256)] + [b"ab", b"cd"]
    vocabulary = tmp_path / "odd.tiktoken"
    vocabulary.write_text("".join(f"{base64.b64encode(x).decode()} {min(i, 256)}\n" for i, x in enumerate(pieces)))
    df = spark.createDataFrame(list(enumerate(["ab cd", "abcd", "xaby", "cd", None, "ab"] * 3)), "doc_id long, text string").coalesce(2)
    rows = {limit: sorted(map(tuple, bpe.encode_texts(df, str(vocabulary), "[a-z]+| ", broadcast_words=limit).collect())) for limit in (100, 0)}
    assert rows[0] == rows[100]
    assert rows[0][0][1:] == (3, hashlib.sha256(b"256,32,256").hexdigest(), hashlib.sha256(b"cd cd").hexdigest())


def test_bpe_decodes_only_matches(spark):
    """What the pattern leaves out is in no token, so it isn't decoded either."""
    ranks = bpe.read_ranks(MULTI)
    texts = ["abc DEF ghi", "plain words", "DEF", "", None, "\ud7ff abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_texts(df, MULTI, "[a-z]+").collect():
        found = re.findall("[a-z]+", texts[r.doc_id] or "")
        ids = [i for w in found for i in bpe.merge_long(w.encode(), ranks)]
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256("".join(found).encode()).hexdigest(), texts[r.doc_id]


def test_bpe_pieces_are_looked_up_once():
    """Known pieces aren't asked for again, new ones once for all texts, and no list is kept for each piece meanwhile."""
    asked, kept = [], []

    def find(words):
        asked.append(sorted(words))
        kept.append(gc.get_count()[0])
        return [str(len(w)) + ",7" for w in words]

    cache = (bpe._Known(), {})
    texts = ["one two, one", None, "", "odd two", "x\x00y one"]
    digest = lambda x: hashlib.sha256(x).hexdigest()
    for _ in range(2):
        counts, ids, decoded = bpe._digests(texts, r" ?[a-z]+|[^ a-z]", find, {b"odd": b"ODD"}, cache)
        rows = [[3, 4, 1, 4], [], [], [3, 4], [1, 1, 1, 4]]
        assert counts == [2 * len(x) for x in rows]
        assert ids == [digest(",".join(f"{n},7" for n in x).encode()) for x in rows]
        assert decoded == [digest(x) for x in (b"one two, one", b"", b"", b"ODD two", b"x\x00y one")]
    assert asked == [[b"\x00", b" one", b" two", b",", b"odd", b"one", b"x", b"y"]]
    gc.collect()
    gc.disable()
    try:
        bpe._digests([" ".join(f"w{i}," for i in range(50_000))], public_tokenizers.PATTERN, find, {}, (bpe._Known(), {}))
    finally:
        gc.enable()
    assert kept[-1] < 1000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, name):
    path = public_tokenizers.path(name)
    library = units.load(open(path, "rb").read())
    expected = sorted((str(i), len((t or "").encode()), len(library.encode([t or ""])[0])) for i, t, _ in ROWS)
    for chunks in (tokencount.Chunks(), tokencount.Chunks(2000, 64, 4)):
        found = tokencount.count_tokens(docs, path, chunks=chunks).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == expected
        assert all(r.over_limit == (r.n_tokens > 1024) for r in found)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_without_spaces(spark, name):
    rng, path = random.Random(5), public_tokenizers.path(name)
    mixed = ["ab ", "  ", "\n", "\t", "日", "é", "it's ", "<|endoftext|>", "1234", "!?"]
    texts = ["".join(rng.choice(x) for _ in range(n)) for x, n in (("日本語分割処理かなカナ漢字東京", 90_000), ("abcdefghijklmnopqrstuvwxyz", 40_000), ("0123456789", 30_000), (mixed, 20_000))]
    texts += ["a" * 40_000, "ñ" * 20_000 + " ok", texts[0]]
    rows = [(1 if t == texts[0] else i, t, "x") for i, t in enumerate(texts, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    library = units.load(open(path, "rb").read())
    expected = sorted((i, len(t.encode()), len(library.encode([t])[0])) for i, t, _ in rows)
    found = tokencount.count_tokens(df, path, chunks=tokencount.Chunks(5000, 256, 8)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == expected


def test_unspaced_text_is_spliced_at_once(spark):
    """No wider overlap is needed, so that no task holds the document."""
    rng = random.Random(6)
    text = "".join(rng.choice("日本語分割処理かなカナ漢字東京") for _ in range(100_000))
    rows = spark.createDataFrame([(1, text, "k")], "id long, text string, text_key string")
    data = units.broadcast_file(spark, GPT)
    chunks = tokencount.Chunks(5000, 256, 8)
    assert tokencount._pieces(rows, 5000, 256).count() == 20
    for size, pieces in ((5256, 1), (5257, 2), (10_256, 2), (10_257, 3)):  # the last chunk always has an overlap to splice at
        assert tokencount._pieces(rows.withColumn("text", F.substring("text", 1, size)), 5000, 256).count() == pieces
    (row,) = tokencount._spliced(rows, "bigint", data, chunks, 256).collect()
    assert row.n_tokens == len(units.load(data.value).encode([text])[0])


def test_token_files(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    idfile.write_ids(docs.where("doc_id IS NOT NULL"), GPT, path)
    library, expected, start = tokenizers.Tokenizer.from_file(GPT), [], 0
    for i, t, _ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in idfile.read_ids(spark, path).collect()) == expected


@pytest.mark.parametrize("top", [1, 40, 50_000, 1_000_000])
def test_range_coder(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 1023, 1024, 1025, 4000):
        ids = rng.zipf(1.2, n).astype(np.int64) % top if top > 1 else np.zeros(n, np.int64)
        lengths, back = idfile.unpack(idfile.pack([n], ids))
        assert lengths.tolist() == [n] and np.array_equal(back, ids)


@pytest.mark.parametrize("n", [511, 1024, 70_001, 300_000])
def test_range_coder_over_many_lanes(n):
    """Ids of 32 bits, few ids, and repeats, in lanes of different lengths."""
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2**32, n), rng.integers(0, 2, n), np.resize(rng.integers(0, 50_000, 700), n), np.full(n, 2**32 - 1)):
        lengths, back = idfile.unpack(idfile.pack([n - 5, 5], ids))
        assert lengths.tolist() == [n - 5, 5] and np.array_equal(back, ids)


def test_lanes_of_a_block_share_a_model(monkeypatch):
    """What one lane has shown helps the others, and the model learns once a round, not once an id."""
    n, calls = 200_000, []
    monkeypatch.setattr(idfile._Model, "learn", lambda self, *a, learn=idfile._Model.learn: calls.append(0) or learn(self, *a))
    ids = np.resize(np.random.default_rng(1).integers(0, 50_000, 3000), n)
    data = idfile.pack([n], ids)
    assert len(data) * 8 < 3 * n and len(calls) < 30
    assert np.array_equal(idfile.unpack(data)[1], ids)


def test_contexts_keep_one_table():
    """What a context predicts and how sure it is are one number of 32 bits, which the model learns as it coded with it."""
    rng = np.random.default_rng(3)
    model = idfile._Model(50, 1000)
    assert [x.dtype for x in model.packed] == [np.int32, np.int32]
    for _ in range(30):
        s1, s2, symbols = (rng.integers(0, 4, 200) for _ in range(3))
        context, e1, e2, guess, kind, chance = model.predict(s1, s2)
        want, votes = model.packed[0].copy() >> 4, model.votes[0].copy()
        seen = model.packed[0] > 0
        for a, x in zip(s1, symbols, strict=True):
            votes[a] += 1 if seen[a] and (e1[s1 == a][0] >> 4) == x else -1
        lost = [a for a in range(4) if (s1 == a).any() and votes[a] < 0]
        model.learn(s1, context, e1, e2, kind, (guess == symbols) & (chance > 0), symbols)
        for a in lost:
            want[a], votes[a] = symbols[s1 == a][-1], 0
        assert np.array_equal(model.packed[0] >> 4, want) and np.array_equal(model.votes[0], np.minimum(votes, 255))


def test_tables_are_turned_in_blocks():
    for shape in ((1, 1), (64, 65), (130, 3), (3, 200), (0, 4)):
        table = np.arange(shape[0] * shape[1]).reshape(shape)
        into = np.empty(shape[::-1], np.int64)
        idfile._turn(table, into)
        assert np.array_equal(into, table.T)


def test_carries_reach_the_words_before():
    """Intervals at the upper end, whose carries run through several words."""
    coder, bits = idfile._Writer(3, 200), np.uint64(16)
    rng = np.random.default_rng(2)
    starts = [np.where(rng.random(3) < 0.9, 65_535, rng.integers(0, 65_536, 3)).astype(np.uint64) for _ in range(100)]
    for x in starts:
        coder.code(x, np.ones(3, np.uint64), bits)
    sizes, data = coder.finish()
    reader = idfile._Reader(sizes, data, 200)
    for x in starts:
        assert np.array_equal(reader.target(3, bits), x)
        reader.code(x, np.ones(3, np.uint64))


def test_damage_is_found():
    data = bytearray(idfile.pack([3000], np.arange(3000) % 700))
    data[-100] ^= 1
    with pytest.raises(ValueError):
        idfile.unpack(bytes(data))


# --- 1, 2, 3 ----------------------------------------------------------------


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "a<|im_end|>\nb\x1a"}]},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "a<|im_end|>\nb\x1a"}], "id": 3},
        {"instruction": "hi", "output": "a<|im_end|>\nb\x1a"},
        {"instruction": "hi", "input": "", "output": "a<|im_end|>\nb\x1a"},
        {"prompt": "hi", "completion": "a<|im_end|>\nb\x1a"},
        {"question": "hi", "answer": "a<|im_end|>\nb\x1a", "source": None},
    ]
    rows = [(k, json.dumps(r), "x") for k, r in enumerate(records)] + [(90, None, ""), (91, "no json", ""), (92, '{"odd": 1}', ""), (93, '{"messages": []}', "")]
    df = spark.createDataFrame(rows, "id int, record string, formatted string")
    formatted = chat.format_records(df, "id", "record")
    template = chat.Template()
    found = {r.id: r for r in formatted.collect()}
    for k in range(len(records)):
        assert template.read(found[k].formatted) == [("user", "hi"), ("assistant", "a<|im_end|>\nb\x1a")]
    assert [found[k].mapping for k in (90, 91, 92, 93)] == [None, None, None, "messages"]
    done = {r.id: r for r in chat.summarise(formatted, "id").collect()}
    assert all(done[k].loss_chars == len("a<|im_end|>\nb\x1a") for k in range(len(records))) and done[90].n_turns == 0


def test_chat_records_lose_no_text(spark):
    """System fields come first; a record with an item that is no object is not shortened but unknown."""
    turns = [("user", "hi"), ("assistant", "ho")]
    layouts = {"messages": ("role", "content"), "turns": ("role", "text"), "conversations": ("from", "value"), "dialog": ("speaker", "text")}
    rows, expected = [], {}
    for field, (role, text) in layouts.items():
        items = [{role: r, text: t} for r, t in turns]
        named = [{**x, "name": "n"} for x in items]
        for record, own in (
            ({field: items, "system": "be kind"}, [("system", "be kind"), *turns]),
            ({field: items, "system": ""}, turns),
            ({field: items, "system": None}, turns),
            ({field: [], "system": "alone"}, [("system", "alone")]),
            ({field: named}, turns),
            ({field: [named[0], items[1]], "system": "s"}, [("system", "s"), *turns]),
            ({field: [*items, "stray"]}, None),
            ({field: [*items, None]}, None),
            ({field: [*items, ["x"]]}, None),
            ({field: [{**items[0], "tool": 1}, items[1]]}, None),
            ({field: "no list"}, None),
            ({field: [{role: None, text: None}]}, [("", "")]),
            ({field: [{role: "user", text: "x" * 300_000}]}, [("user", "x" * 300_000)]),
        ):
            expected[len(rows)] = own
            rows.append((len(rows), json.dumps(record)))
    df = spark.createDataFrame(rows, "id int, record string")
    template = chat.Template()
    for r in chat.format_records(df, "id", "record").collect():
        assert (None if r.mapping is None else template.read(r.formatted)) == expected[r.id], rows[r.id][1][:200]


def test_chat_tables_with_nulls_repeats_and_nothing(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "first"), (None, 1, "user", "x"), (2, 1, "user", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, record string")
    records = chat.records_of_turns(df, "conv_id", "turn", "role", "text")
    found = {r.conv_id: chat.Template().read(r.formatted) for r in chat.format_records(records, "conv_id", "record").collect()}
    assert found == {1: [("", "first"), ("user", ""), ("user", ""), ("assistant", "b")], None: [("user", "x")], 2: [("user", "")]}
    none = chat.records_of_turns(df.where("1 = 0"), "conv_id", "turn", "role", "text")
    assert chat.summarise(chat.format_records(none, "conv_id", "record"), "conv_id").collect() == []


def test_chat_template_is_reversible():
    rng, template = random.Random(8), chat.Template()
    parts = [*template.control, "\x1a", "A", "Z", "\n", "user", "<", "|", "s>"]
    for _ in range(500):
        turns = [("".join(rng.choices(parts, k=3)), "".join(rng.choices(parts, k=6))) for _ in range(3)]
        assert template.read(template.write(turns)[0]) == turns


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(x) for x in m[0] if x.isdigit()]
            luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            fits = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns():
    rng = random.Random(9)
    parts = ["a", "@", ".", "b.c", "1", "25", "255", "256", " ", "-", "+", "(", ")", "4111111111111111", "x@y.z", "é", "\n", "10.0.0.1", "+1 (555) 010-9999"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.find_spans(text) == plain_spans(text), text


def test_revealing_terms(spark):
    rows = [(k, f"Zorblat wrote from boss@corp.com today, number {k}") for k in range(4)] + [(10 + k, f"wrote today from number home {k}") for k in range(300)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    for limit in (300_000, 0):
        found = {r.doc_id: r for r in pii.sanitise(df, broadcast_terms=limit).collect()}
        assert [s.kind for s in found[0].spans] == ["term", "email"] and found[0].sanitised == " wrote from [EMAIL] today, number 0"
        assert found[10].spans == [] and found[900].sanitised == ""


def brute_disclosure(texts):
    """Revealing pairs by plain sets: whole documents, exact and pooled entities."""
    held, having = {}, {}
    for k, t in enumerate(texts):
        spans = plain_spans(t or "")
        for start, kind, end in spans:
            v = t[start:end].lower() if kind == 0 else "".join(x for x in t[start:end] if x.isdigit() or kind == 1 and x == ".")
            pool = ("@" + v.split("@")[-1], v[: v.rfind(".") + 1], v[:6] + "*", v[:-7] + "*")[kind]
            for name in (f"{pii.KINDS[kind]}:{v}", f"{pii.KINDS[kind]}:{pool}", pii.KINDS[kind]):
                held.setdefault(name, set()).add(k)
        unspaced = [False, *(0x3040 <= ord(x) <= 0x30FF or 0x4E00 <= ord(x) <= 0x9FFF for x in t or ""), False]
        for m in re.finditer(r"\w+", t or ""):
            bounds = [m.start(), *(i for i in range(m.start() + 1, m.end()) if unspaced[i] != unspaced[i + 1]), m.end()]
            for low, high in zip(bounds, bounds[1:]):
                if high - low > 1 and not any(start < high and low < end for start, _, end in spans):
                    own = [t[i : i + 2] for i in range(low, high - 1)] if unspaced[low + 1] else [t[low:high].lower()]
                    for w in own:
                        having.setdefault(w, set()).add(k)
    least, out = 2 * np.log(len(held) * len(texts)), {}
    for e, in_e in held.items():
        for w in {w for w in having if having[w] & in_e}:
            both, ratio = len(in_e & having[w]), 0.0
            for n, row, column in (
                (both, len(in_e), len(having[w])), (len(in_e) - both, len(in_e), len(texts) - len(having[w])),
                (len(having[w]) - both, len(texts) - len(in_e), len(having[w])),
                (len(texts) - len(in_e | having[w]), len(texts) - len(in_e), len(texts) - len(having[w])),
            ):
                ratio += 2 * n * np.log(n * len(texts) / (row * column)) if n else 0.0
            if ratio >= least and 2 * both >= len(having[w]) and both * len(texts) > len(in_e) * len(having[w]):
                out[e, w] = round(both / len(having[w]), 9)
    return out


def test_disclosure_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.collect()]
    expected = brute_disclosure(texts)
    assert len(expected) > 20
    for limit in (300_000, 0):
        found = {(r.entity, r.term): round(r.share, 9) for r in pii.revealing_terms(docs, broadcast_terms=limit).collect()}
        assert found == expected
    assert queries.op2_pii(spark, "/root/testdata/sf0.01").where("n_term > 0").count() > 0


def test_terms_with_digits_and_without_spaces(spark):
    told = [f"user42 of Wu has AKIA12345 and 0077-1234, 山田太郎さんno, at me{k}@corp.com" for k in range(30)]
    other = [f"plain user of has and at text 123{k} 田んぼ at" for k in range(70)]
    texts = [*told, *other, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_disclosure(texts)
    assert {("email:@corp.com", x) for x in ("user42", "wu", "akia12345", "0077", "1234", "山田", "田太", "さん", "no")} <= expected.keys()
    for limit in (300_000, 0):
        assert {(r.entity, r.term): round(r.share, 9) for r in pii.revealing_terms(df, broadcast_terms=limit).collect()} == expected
        rows = {r.doc_id: r for r in pii.sanitise(df, broadcast_terms=limit).collect()}
        for word in ("user42", "Wu", "AKIA12345", "山", "田", "太", "郎"):
            assert word not in rows[3].sanitised
        assert rows[40].spans == [] and "[EMAIL]" in rows[3].sanitised


def test_hot_and_pooled_entities_have_terms(spark):
    hot = [f"Quibble regards reach me at one{k}@corp.com or two" for k in range(40)] + [f"plain text of number {k}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(hot)), "doc_id long, text string")
    found = {(r.entity, r.term) for r in pii.revealing_terms(df).collect()}
    assert {("email:@corp.com", "quibble"), ("email", "quibble"), ("email", "two")} <= found


def test_wrappers(spark):
    page = "<html><body><nav><a href=x>Menu</a></nav><div class='main'><h2>T{0}</h2><p>Text <b>o</b>f {0} &amp; more<br>x<p>second {0}<div class=comments>bad</div></div><footer>f</footer>"
    rows = [(k, "http://h.example/x", page.format(k)) for k in range(5)] + [(50, None, None), (51, "no url", ""), (52, "http://h.example/y", "<p <broken"), (53, "http://h.example/x", page.format(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit("clash"))
    found = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert found[1] == "T1 Text of 1 & more x second 1" == found[53] and found[50] == found[51] == ""
    expression = wrappers.infer_wrappers(df).where("host = 'h.example'").first().wrapper
    assert "#SLOT" in expression and "?" in expression


def test_deep_pages(spark):
    page = "<body><div class=wrap><article>Start {0}" + "<div>" * 90 + "deep {0}<nav>menu <div>in</div></nav> on" + "</div>" * 90 + "<p>end {0}</article><p>out</div><footer>f</footer>"
    rows = [(k, "http://deep.example/", page.format(k)) for k in range(4)]
    rows += [(k, "http://low.example/", "<div>" * 80 + f"menu <div>bar</div><article>low {k}<form>f</form><p>on</article>") for k in (7, 8)] + [(9, "http://deeper.example/", "<article>" + "<p><div>" * 20_000 + "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert found == {k: f"Start {k} deep {k} on end {k}" for k in range(4)} | {k: f"low {k} on" for k in (7, 8)} | {9: "x"}


@pytest.mark.parametrize("script", ["for(i=0;i<n;i++){f()}", "x = '<!--'", "if(a<b){s=\"</scripts>'\"}", "'<b title=\"'", ""])
def test_scripts_end_at_their_end_tag(script):
    page = f"<body><article>one<script>{script}</SCRIPT >two<style>a<b{{}}</style>three</article><script>{script}"
    assert [t for _, t in wrappers.parse(page)[1]] == ["onetwothree"]


def read_hosts(spark, hosts):
    """Texts of pages by host, in order."""
    rows = [(k, f"http://{host}/x", page) for host, pages in hosts.items() for k, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {(r.url, r.page_id): r.text for r in wrappers.extract(df).collect()}
    return {host: [found[f"http://{host}/x", k] for k in range(len(pages))] for host, pages in hosts.items()}


def test_alignment_alone_tells_template_from_text(spark):
    """No article, no telling names: only what differs between the pages of a host is text."""
    boxes = "<html><body><div><div>Home Products Contact</div><div><h2>Title {0}</h2><p>Text of {0}.</p>{1}<p>Share this page</p></div><div>All rights reserved by us since long ago</div></div></body></html>"
    table = "<html><body><table><tr><td>Home Products</td></tr></table><div><section><h3>Head {0}</h3>{1}</section><section>Call us today</section></div></body></html>"
    want_more = [f"{'more ' * (20 + k)}{k}" for k in range(6)]
    more = [f"<p>{x}</p>" for x in want_more]
    found = read_hosts(spark, {"one": [boxes.format(k, more[k]) for k in range(6)], "two": [table.format(k, more[k]) for k in range(6)]})
    assert found["one"] == [f"Title {k} Text of {k}. {want_more[k]}" for k in range(6)]
    assert found["two"] == [f"Head {k} {want_more[k]}" for k in range(6)]


def test_optional_boxes_and_copies(spark):
    page = "<html><body><div>Menu of all</div>{ad}<div><h2>T{k}</h2>{ps}</div><div>Foot of all</div></body></html>"
    ps = ["".join(f"<p>par {k} {n}</p>" for n in range(k + 1)) for k in range(5)]
    texts = [" ".join([f"T{k}", *[f"par {k} {n}" for n in range(k + 1)]]) for k in range(5)]
    pages = [page.format(ad="<div class='x'>Buy</div>" * (k == 2), k=k, ps=ps[k]) for k in range(5)]
    same = ["<html><body><div><p>All the same</p><p>text</p></div></body></html>"] * 4
    found = read_hosts(spark, {"h": pages, "copies": same})
    assert found["h"] == texts and found["copies"] == ["All the same text"] * 4


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ('<body class="has-sidebar"><p>a</p></body>', "a"),
        ("<body><form id=aspnetForm><div><p>a</p></div></form></body>", "a"),
        ('<body><div class="post-comments-open"><p>a</p></div></body>', "a"),
        ('<article><p>a</p><div class="market-share">b</div></article>', "a b"),
        ('<article><p>a</p><section id="search-results-explained">b</section></article>', "a b"),
        ("<article><header><h1>a</h1></header><p>b</p></article>", "a b"),
        ('<article><p>a</p><div class="ad-box">b</div><section id="comments">c</section><form>d</form></article><header>e</header>', "a"),
        ("<body><header><h1>a</h1></header><p>b</p><div class='cookie-notice'>c</div></body>", "b"),
    ],
)
def test_names_of_side_elements(spark, body, text):
    assert read_hosts(spark, {"h": [body]})["h"] == [text]


def test_long_pages_align_fast_and_wrappers_stay_small():
    import random
    import time

    rng = random.Random(3)
    kinds = ["<p>%s</p>", "<div>%s</div>", "<ul><li>%s</ul>", "<h2>%s</h2>", "<div><p>%s</div>"]
    pages = ["<body>" + "".join(rng.choice(kinds) % ("word " * 10 + str(rng.random())) for _ in range(3000)) + "</body>" for _ in range(2)]
    assert min(map(len, pages)) > 200_000
    a, b = (wrappers.parse(x)[0] for x in pages)
    start = time.process_time()
    out = wrappers._align(a, b)
    assert time.process_time() - start < 2 and out.size() < 100
    for _ in range(200):
        out = wrappers._align(out, wrappers.parse("<body>" + "".join(rng.choice(kinds) % rng.random() for _ in range(40)) + "</body>")[0])
    assert out.size() < 100


# --- pipeline ---------------------------------------------------------------


def brute_quality(text):
    """The quality stage's verdict, by dictionaries of all windows and prefixes."""
    words = split_words(text)
    n = len(words)
    windows = {}
    for i in range(n - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {p for own in windows.values() if len(own) > 1 for i in own for p in range(i, i + 8)}
    longest = 0
    for own in windows.values():
        for x, i in enumerate(own):
            for j in own[x + 1 :]:
                k = 8
                while j + k < n and words[i + k] == words[j + k]:
                    k += 1
                longest = max(longest, k)
    return n >= 20 and 100 * len(inside) <= 30 * n and 100 * longest <= 20 * n


def brute_lines(rows):
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line, set()).add(site or "")
    shared = {line for line, own in sites.items() if len(own) >= 10}
    out = {}
    for i, text, _ in rows:
        kept = [x for x in (text or "").split("\n") if x not in shared]
        out[i] = "\n".join(kept) if text is not None and any(x.strip(" ") for x in kept) else text
    return out


def brute_clean(texts, items):
    tokens = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    banned = set()
    for t in items:
        w = tokens(t)
        size = min(10, len(w))
        banned |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
    sizes = {len(x) for x in banned}
    clean = {}
    for i, t in texts.items():
        w = tokens(t)
        clean[i] = not any(tuple(w[k : k + size]) in banned for size in sizes for k in range(len(w) - size + 1))
    return {i for i, good in clean.items() if good}


def test_pipeline(spark):
    """Every stage against plain Python; the last one against the tokenizer's library."""
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = []
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF_DIR)
        stages.append({r.doc_id: r for r in docs.collect()})
    rows = [r for r in rows if brute_quality(r[1])]
    assert set(stages[0]) == {i for i, *_ in rows}
    texts = brute_lines(rows)
    assert {i: r.text for i, r in stages[1].items()} == texts and all(r.n_chars == len(r.text) for r in stages[1].values())
    lows = {low for _, n, low in brute_components(list(texts.items())) if n} | {i for i, t in texts.items() if not split_words(t)}
    texts = {i: texts[i] for i in lows}
    assert {i: r.text for i, r in stages[2].items()} == texts
    clean = brute_clean(texts, [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()])
    assert set(stages[3]) == clean
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = set()
    for i in clean:
        ids = own.encode_ordinary(texts[i])
        expected.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()} == expected


def test_pipeline_with_nulls_clashes_and_nothing(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words), "a"), (2, " ".join(words), "b"), (None, " ".join(words[::-1]), None), (3, None, "a"), (4, "", "b"), (5, " ".join(words[5:35:2] + words[:9]), None)]
    df = spark.createDataFrame([(*r, None, 0, "x") for r in rows], "doc_id long, text string, source string, n_chars int, n_lines int, gone_id string")
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        assert function(spark, df.where("1 = 0"), SF_DIR).collect() == []
    for k, (name, function) in enumerate(corpus_pipeline.STAGES[:4]):
        df = function(spark, df, SF_DIR)
        assert df.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "gone_id"], name
    assert sorted(str(r.doc_id) for r in df.collect()) == ["1", "5", "None"]
    assert corpus_pipeline.STAGES[4][1](spark, df, SF_DIR).count() == 3


def test_profiles_never_rule_a_link_out():
    rng = np.random.default_rng(5)
    for size in (1, 9, 40, 3000):
        for gone in range(0, size // 9 + 1, max(1, size // 90)):
            one = np.unique(rng.integers(0, 2**64, size, np.uint64))
            two = np.unique(np.concatenate([one[gone:], rng.integers(0, 2**64, gone, np.uint64)]))
            apart = np.abs(neardup.profile(one, 256).astype(int) - neardup.profile(two, 256)).sum()
            assert apart <= len(np.setxor1d(one, two))
            linked = 100 * len(np.intersect1d(one, two)) >= 80 * len(np.union1d(one, two))
            assert not linked or apart * 180 <= (len(one) + len(two)) * 20
