"""Operators 11 to 13 against plain numpy and Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm import eigen, packing, queries, units, variants, whitening

SF = "/root/testdata/sf0.001"


# --- eigen and whitening -----------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_leading_eigenpairs(n):
    a = np.random.default_rng(n).standard_normal((2 * n, n))
    matrix = a.T @ a
    values, vectors = eigen.leading(matrix, 16)
    expected = np.linalg.eigvalsh(matrix)[::-1][:16]
    assert np.abs(values - expected).max() < 1e-13 * expected[0]
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-13 * expected[0]
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13


def wilkinson():
    return np.diag(np.abs(np.arange(21) - 10.0)) + np.eye(21, k=1) + np.eye(21, k=-1)


@pytest.mark.parametrize("matrix", [np.eye(20), np.kron(np.eye(5), np.ones((4, 4))), wilkinson(), np.diag([3.0, 3, 3, 1, 1, 0, 0])])
def test_clustered_eigenvalues_have_orthogonal_vectors(matrix):
    values, vectors = eigen.leading(matrix, 16)
    positive = np.linalg.eigvalsh(matrix)[::-1][:16]
    assert np.allclose(values, positive[positive > 1e-9], atol=1e-13)
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-13 * 16
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13


def test_sturm_counts():
    matrix = wilkinson()
    at = np.array([-2.0, 0.3, 5.0, 20.0])
    expected = [(np.linalg.eigvalsh(matrix) < x).sum() for x in at]
    assert eigen.below(np.diagonal(matrix).copy(), np.ones(20), at).tolist() == expected


def brute_whitening(rows, scale=64, shift=1_000_000):
    kept = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64) + shift) for i, v in rows]
    x = np.stack([v for _, v in kept])
    different = np.unique(x, axis=0)
    n, sums = len(different), different.sum(axis=0)
    centred = different - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    good = values > 1e-9
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors[:, good] / np.sqrt(values[good]), values[good] / np.trace(centred.T @ centred / n)


def test_op11_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, deviation, whitened, explained = brute_whitening(rows)
    found = queries.op11_whitening(spark, SF).toPandas()
    assert found.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found) == 16 * len(rows) and set(found.n) == {n} and found.identity_error.max() < 1e-9
    table = found.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    signs = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table * signs - whitened).max() < 1e-8
    by_id = found[found.component == 1].set_index("vec_id").deviation
    assert by_id.loc[[i for i, _ in rows]].tolist() == deviation.tolist()
    assert np.allclose(found.groupby("component").explained.first(), explained, rtol=1e-9)


def test_whitening_leaves_out_bad_rows_and_counts_copies_once(spark):
    good = [(i, v) for i, v in enumerate(np.random.default_rng(1).normal(size=(40, 3)).tolist())]
    good += [(100, good[0][1]), (100, good[0][1]), (None, [0.1, 0.2, 0.3]), (101, [1e4, -1e4, 3.0])]
    bad = [(1, None), (2, [1.0, None, 2.0]), (3, [float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + bad], "vec_id long, embedding array<double>, whitened string")
    model = whitening.fit(df)
    n, deviation, whitened, explained = brute_whitening(good)
    assert model.n == n == 42 and np.allclose(model.explained(), explained)
    found = whitening.transform(df, model).collect()
    assert sorted(r.deviation for r in found) == sorted(deviation.tolist())
    assert sorted(str(r.vec_id) for r in found) == sorted(str(i) for i, _ in good)
    assert np.allclose(sorted(abs(r.whitened[0]) for r in found), sorted(np.abs(whitened[:, 0])), atol=1e-8)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_whitening_without_spread_has_no_components(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = whitening.fit(df)
    assert len(model.values) == 0
    found = whitening.transform(df, model).collect()
    assert len(found) == (2 if len(rows) == 2 else 0) and all(r.whitened == [] and r.deviation == 0 for r in found)


def test_constant_dimension_and_huge_entries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), 5.0, float(b)]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    assert len(whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).values) == 2
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e15, 2.0])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert model.sums[0] == int(64e15) and {r.deviation for r in whitening.transform(df, model).collect()} == {None}


def test_deviations_are_exact_in_both_ways():
    table = np.array([[3, 5], [2**40, -(2**40)]])
    assert whitening.deviations(table[:1], 7, [20, 30]).to_pylist() == [1 + 25]
    assert whitening.deviations(table, 3, [0, 0]).to_pylist() == [9 * 34, None]


# --- packing -----------------------------------------------------------------

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_word_units_are_encoded_like_whole_texts():
    library = units.load(open(WORDS, "rb").read())
    assert library.spaced
    rng = np.random.default_rng(5)
    bits = [*"abzAZ09'.,!-<>|\n \té̸́ÀßÿĀ×İΣς漢カ　\xa0²Ⅷ​\x85\x1c$%&(", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "word"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(5000)]
    assert library.packed(texts) == [np.array(x, "<u4").tobytes() for x in library.encode(texts)]


def configurations(rng):
    yield "mixed", np.minimum(rng.lognormal(6.3, 1, 3000).astype(int) + 1, 4096)
    yield "thirds", rng.integers(1200, 1500, 3000)
    yield "halves", rng.integers(1900, 2200, 1000)
    yield "alike", np.full(5000, 1365)
    yield "few", rng.integers(1, 4097, 7)
    yield "ones", np.ones(9000, int)
    yield "none", np.zeros(0, int)


@pytest.mark.parametrize("name, lengths", list(configurations(np.random.default_rng(3))))
def test_plan_is_whole_and_close_to_the_bound(name, lengths):
    histogram = np.bincount(lengths, minlength=4097)
    plan = packing.planned(histogram)
    length = np.repeat(np.arange(4097), histogram)
    number = np.concatenate([np.arange(n) for n in histogram])
    held = defaultdict(list)
    if len(length):
        for s, o, k in zip(*(x.tolist() for x in plan.place(length, number)), length.tolist()):
            held[s].append((o, k))
    assert len(held) == plan.sequences >= plan.at_least
    for own in held.values():
        ends = np.cumsum([k for _, k in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    longest_first = sum(n for _, n in packing.rounded(histogram, [], 4096))
    assert plan.sequences <= longest_first * 1.01 + 1
    if name in ("mixed", "alike", "ones"):
        bound = {"alike": 1667}.get(name, plan.at_least)
        assert plan.sequences <= bound * 1.01 + 1


def test_knapsack_against_brute_force():
    knapsack = packing._Knapsack(12, 12)
    for seed in range(20):
        prices = np.where(np.random.default_rng(seed).random(13) < 0.5, np.random.default_rng(seed + 99).random(13) * np.arange(13), 0.0)
        counts = knapsack.best(prices)
        best = [0.0] * 13
        for room in range(1, 13):
            best[room] = max([best[room - 1]] + [prices[k] + best[room - k] for k in range(1, room + 1)])
        assert sum(k * n for k, n in counts.items()) <= 12
        assert sum(prices[k] * n for k, n in counts.items()) == pytest.approx(best[12])


def test_op12_against_the_library(spark):
    tokenizer = Tokenizer.from_file(WORDS)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op12_packing(spark, SF).collect()
    check_pieces(found, docs, tokenizer, 4096)


def check_pieces(found, docs, tokenizer, capacity):
    expected = set()
    for i, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            expected.add((i, piece, at, len(own), zlib.crc32(own.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == expected and len(found) == len(expected)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        ends = np.cumsum([k for _, k in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    total = sum(r.length for r in found)
    assert len(held) <= 1.02 * -(-total // capacity) + 1


@pytest.mark.parametrize("broadcast_offsets", [0, 1_000])
def test_packing_cuts_repeats_and_nulls(spark, broadcast_offsets):
    tokenizer = Tokenizer.from_file(WORDS)
    rng = np.random.default_rng(4)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma,", "Σ"], rng.integers(0, 150))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "lorem ipsum " * 900}
    df = spark.createDataFrame([(i, t, i, 0) for i, t in texts.items()], "doc_id long, text string, sequence_id long, part int").repartition(5)
    small = packing.Packing(capacity=128, cells=32)
    packed = packing.pack(df, WORDS, packing=small, with_ids=True, broadcast_offsets=broadcast_offsets)
    found = packed.collect()
    check_pieces(found, texts, tokenizer, 128)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in found:
        assert zlib.crc32(whole[r.sequence_id][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, "x y", 0, 0)], df.schema))
    again = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(twice, WORDS, packing=small).collect())
    once = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found}
    assert {k for k, n in again.items() if n == 2} == once and [k[0] for k, n in again.items() if n == 1] == [None]


def test_packing_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, WORDS).collect() == []


# --- spelling variants ---------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, misspelt=199, least=6, often=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspelt and h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def brute_group(n):
    near = defaultdict(set)
    masked = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            masked[w[:i], w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for same in masked.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), k, len(near[w]), n.get(form.get(w))) for w, k in n.items()}


def as_set(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_op13_against_python(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert as_set(queries.op13_spelling_variants(spark, SF)) == brute_group(brute_words(rows))


def test_words_with_nulls_repeats_and_long_runs(spark):
    rows = [(1, "Wörter wörter WÖRTER x×y÷zabc straße\nstraße, l'école"), (None, "abcdefg " * 6), (2, None), (3, ""), (4, "zz" * 3000 + " " + "long" * 200)]
    rows += rows[:2] + [(i, "Abcdefg ABCDEFH abcdef") for i in range(10, 420)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id int, text string, word string, n int")
    rule = variants.Spelling(misspelt=199, min_count=2)
    found = {r.word: r.n for r in variants.count_words(df, rule=rule).collect()}
    assert found == brute_words(rows, often=2) and "zz" * 3000 not in found
    plain = {r.word: r.n for r in variants.count_words(df, rule=variants.Spelling(min_count=1)).collect()}
    assert plain == brute_words(rows, 0, often=1)


def random_counts(rng, size):
    words = {"".join(rng.choice(list("abé漢"), rng.integers(6, 9))): int(rng.integers(1, 60)) for _ in range(size)}
    long = "x" * 40
    return words | {long: 100, long[1:]: 7, long[:-1] + "y": 3, "y" + long: 1, "aaaaaa": 500, "aaaaaaa": 50, "aaaaaaaa": 5, "aaaaaaaab": 1}


@pytest.mark.parametrize("max_bytes", [256 << 20, 1])
def test_groups_and_chains_against_python(spark, max_bytes):
    counts = random_counts(np.random.default_rng(6), 600)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = as_set(variants.group(df, variants.Spelling(max_bytes=max_bytes)))
    assert found == brute_group(counts)
    by_word = {r[0]: r for r in found}
    assert by_word["aaaaaaaa"][2] == "aaaaaa"


@pytest.mark.parametrize("counts", [{}, {"single": 9}, {"single": 5, "singles": 25}, {"single": 5, "singles": 24, "shingle": 1}])
def test_few_words(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_set(variants.group(df)) == brute_group(counts)


def test_ties_go_to_the_smallest(spark):
    counts = {"mother": 1, "nother": 9, "bother": 9, "other": 9}
    assert as_set(variants.group(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute_group(counts)


def test_filter_never_misses(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdef"), 7)) for _ in range(2000)]
    empty = variants.empty_shard(7, len(words))
    block, digits = empty.place(variants._sums(variants._points(words, 7))[:, -1])
    bits = np.zeros(empty.blocks, np.uint64)
    np.bitwise_or.at(bits, block, empty.mask(digits))
    shard = variants.Shard(empty.blocks, empty.probes, 0, bits)
    assert shard.has(variants._sums(variants._points(words, 7))[:, -1]).all()
    others = ["".join(rng.choice(list("uvwxyz"), 7)) for _ in range(5000)]
    assert shard.has(variants._sums(variants._points(others, 7))[:, -1]).mean() < 0.03


def test_segments_are_sent_in_bounded_rounds():
    shards = {6: variants.Shard(5 * variants.SEGMENT, 4), 7: variants.Shard(10, 4)}
    assert variants.rounds(shards, 2 * 8 * variants.SEGMENT) == [[(6, 0, 2)], [(6, 2, 4)], [(6, 4, 5), (7, 0, 1)]]


def test_empty_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(variants.count_words(df)).collect() == []
