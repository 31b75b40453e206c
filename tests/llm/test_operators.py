"""Operators on small tables: against brute force, round trips, odd rows."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ampline.llm import chat_format, decontaminate, exact_dedup, jaccard_join, language, license_scan, mixing, registry, token_counts, token_files, toxicity
from ampline.llm.common import slices

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "  \n ", "Hello, World!", "hello, world!", "ΣΑΣ it's<|endoftext|>ok", "word " * 20_000, "été Ünï £5 naïve", "Hello, World!"]


def table(spark, texts, ids=None):
    """documents with a null id, a repeated id and columns of clashing names"""
    ids = ids or [*range(len(texts) - 2), None, 0]
    rows = [(i, t, "en", f"s{k % 3}", 1, 0.5, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, score double, lang_pred string")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def test_no_rows_in_no_rows_out(spark, empty):
    assert token_counts.token_counts(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0
    assert jaccard_join.similar_components(empty).count() == 0
    assert token_files.token_files(empty).count() == 0
    assert decontaminate.flag_leaks(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert toxicity.score_toxicity(empty, None).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def greedy(word, first, later):
    """Pieces of a word by taking the longest each time; 0 if it can't be spelled so."""
    n = 0
    while word:
        known = later if n else first
        size = next((k for k in range(len(word), 0, -1) if word[:k] in known), 0)
        if not size:
            return 0
        word, n = word[size:], n + 1
    return n


def test_token_lengths_are_those_of_greedy_pieces():
    rng = random.Random(3)
    for _ in range(30):
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(12)]
        vocabulary = [f"{token_counts.WORD_START}{p}" if rng.random() < 0.5 else p for p in pieces]
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
        first = {p[1:] for p in vocabulary if p.startswith(token_counts.WORD_START)}
        later = {p for p in vocabulary if not p.startswith(token_counts.WORD_START)}
        assert token_counts.Automaton(vocabulary).lengths(words).tolist() == [greedy(w, first, later) for w in words]


def test_token_counts_of_odd_rows(docs):
    got = token_counts.token_counts(docs).collect()
    assert len(got) == len(TEXTS)
    assert {r.n_words for r in got} >= {0, 2, 20_000}


def test_mix_meets_its_quotas(spark):
    rows = [(k, "w " * (1 + k % 7), "big" if k < 900 else f"s{k % 4}") for k in range(1200)] + [(None, None, None), (5, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.mix_source: r for r in mixing.mix_plan(docs).collect()}
    drawn = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("mix_tokens").alias("n")).collect()}
    assert abs(sum(r.weight for r in plan.values()) - 1) < 1e-9
    for source, r in plan.items():
        assert r.quota <= drawn[source[1:]] < r.quota + 7
    assert max(r.quota / r.tokens for r in plan.values()) <= mixing.MixConfig().repeats + 1e-6


def test_rows_that_repeat_are_drawn_one_by_one(spark):
    """A source of 900 equal rows of 10 tokens, of which a part is wanted, whatever the tasks."""
    rows = [(1, "w " * 10, "same", k) for k in range(900)] + [(k, "w " * 3, "other", k) for k in range(2, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, before int").repartition(7)
    config = mixing.MixConfig(entropy=0.999, budget=0.8)
    plan = {r.mix_source: r for r in mixing.mix_plan(docs, config).collect()}
    drawn = {r.source: r for r in mixing.mix(docs, config).groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.count("*").alias("rows"), F.countDistinct("before").alias("different")).collect()}
    same = plan["1same"]
    assert 0 < same.quota < 9000
    assert same.quota <= drawn["same"].n < same.quota + 10
    assert drawn["same"].rows == drawn["same"].different
    assert plan["1other"].quota <= drawn["other"].n < plan["1other"].quota + 3


def best_exponent(tokens, config):
    """The nearest to 1 on a fine grid that reaches the entropy, or the least that keeps the repeat limit if that is greater."""
    share = np.array(tokens, float) / sum(tokens)
    grid = np.arange(0, 1 + 1e-12, 1e-4)
    weights = share ** grid[:, None]
    weights /= weights.sum(1, keepdims=True)
    entropy = -(weights * np.log(weights)).sum(1)
    repeats = (config.budget * sum(tokens) * weights / np.array(tokens, float)).max(1)
    reach = grid[entropy >= config.entropy * np.log(len(tokens)) - 1e-9]
    keep = grid[repeats <= config.repeats]
    return max(reach.max() if len(reach) else 0.0, keep.min() if len(keep) else 1.0)


@pytest.mark.parametrize(("entropy", "repeats", "budget"), [(0.9, 100.0, 1.0), (0.97, 1.5, 1.0), (1.0, 1e9, 0.5), (0.2, 3.0, 2.5), (0.99, 2.0, 3.0)])
def test_the_mix_is_the_grid_exponents_and_a_plain_sort_draws_it(spark, entropy, repeats, budget):
    config = mixing.MixConfig(entropy=entropy, repeats=repeats, budget=budget)
    rng = random.Random(int(entropy * 100))
    rows = [(k, " ".join(["w"] * rng.randint(1, 9)), rng.choice(["big"] * 20 + ["mid"] * 5 + ["small"]), 1.5) for k in range(400)]
    rows += [rows[0], rows[0], (None, "a b", None, 0.0), (7, None, "none", 0.0), (8, " ", "none", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_tokens double")
    tokens = {}
    for _, text, source, _ in rows:
        tokens[source] = tokens.get(source, 0) + len((text or "").split())
    tokens = {s: n for s, n in tokens.items() if n}
    total, a = sum(tokens.values()), best_exponent(list(tokens.values()), config)
    plan = {r.mix_source: r for r in mixing.mix_plan(docs, config).collect()}
    assert set(plan) == {"0" if s is None else f"1{s}" for s in tokens}
    z = sum((n / total) ** a for n in tokens.values())
    hashes = {(r.doc_id, r.text, r.source): r.h for r in docs.withColumn("h", F.xxhash64(F.lit(config.seed), "doc_id", "text")).collect()}
    want = []
    for s, n in tokens.items():
        r = plan["0" if s is None else f"1{s}"]
        assert r.tokens == n
        assert r.weight == pytest.approx((n / total) ** a / z, abs=2e-3)
        assert r.quota == int(r.weight * budget * total + 1e-9)
        mine = sorted((hashes[x[:3]], x) for x in rows if x[2] == s)
        epochs, rest = divmod(r.quota, n)
        want += [x for _, x in mine] * epochs
        taken = 0
        for _, x in mine:
            if taken >= rest:
                break
            want.append(x)
            taken += len((x[1] or "").split())
    drawn = mixing.mix(docs, config)
    assert drawn.columns == ["doc_id", "text", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_place"]
    assert sorted((tuple(r)[:3] for r in drawn.collect()), key=repr) == sorted((x[:3] for x in want), key=repr)
    kept = mixing.draw(docs, config).select(docs.columns).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("part_bytes", [32 << 20, 12])
def test_chats_come_back(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(chat_format, "PART_BYTES", part_bytes)
    monkeypatch.setattr(chat_format, "slices", lambda batches, column: slices(batches, column, 8))
    tricky = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "", None, "a\nb", "<\\\\|", "été"]
    turns = [(c, t, ("user", "assistant", "odd\nrole\\", None)[(c + t) % 4], tricky[(c * 3 + t) % 7]) for c in range(6) for t in range(5)] + [(None, 1, "user", "x"), (None, 2, "assistant", "y")]
    turns += [(9, 1, "user", "same"), (9, 1, "user", "same"), (10, None, "assistant", "z" * 50), (10, None, "assistant", "z" * 50)]
    rows = spark.createDataFrame([(*x, 7) for x in turns], "conv_id long, turn int, role string, text string, part int")
    if part_bytes == 12:  # in this process, where the small sizes hold
        first = lambda x: (x is not None, x)
        ordered = sorted(turns, key=lambda x: (first(x[0]), first(x[1]), x[2] or "", x[3] or ""))
        turn_rows = pa.table({"conv_id": pa.array([x[0] for x in ordered], pa.int64()), "role": [x[2] or "" for x in ordered], "text": [x[3] or "" for x in ordered]})
        made = list(chat_format._format(turn_rows.to_batches(max_chunksize=3)))
        read = [Row(**x) for b in made for x in b.to_pylist()]
        digested = [Row(**x) for b in chat_format._digest(made) for x in b.to_pylist()]
    else:
        made = chat_format.format_chats(rows)
        read, digested = made.collect(), chat_format.digests(made).collect()
    found = {}
    for r in read:
        raw = r.formatted.encode()
        x = found.setdefault(r.conv_id, [[], [], 0, 0])
        assert r.part == x[3]
        x[0] += chat_format.parse(r.formatted)
        x[1] += [chat_format.unescape(raw[a:b].decode()) for a, b in zip(r.loss_start, r.loss_end, strict=True)]
        x[2], x[3] = x[2] + len(r.formatted), x[3] + 1
    assert (max(x[3] for x in found.values()) > 1) == (part_bytes == 12)
    want = {}
    for c, _, role, text in turns:
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: x[0] for c, x in found.items()} == want
    said = {c: [t for role, t in x if role == "assistant"] for c, x in want.items()}
    assert {c: x[1] for c, x in found.items()} == said
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = {r.conv_id: tuple(r)[1:] for r in digested}
    assert digests == {c: (len(x), hexed("".join(f"{role}\n{t}\n" for role, t in x)), len("".join(said[c])), hexed("".join(said[c])), found[c][2]) for c, x in want.items()}


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.op4_toxicity(spark, SF).where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    assert sum(r.toxic == r.predicted for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxic_documents_are_found_where_there_are_labels_to_learn_from(spark):
    """With 352 toxic rows to learn from (of 0.001 and 0.01, 10 and 45: too few to tell words by) most others are found."""
    sf_dir = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    n = {(r.toxic, r.predicted): r["count"] for r in toxicity.op4_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0))
    assert n[1, 1] >= 0.95 * (n[1, 1] + n.get((0, 1), 0))


def test_toxicity_of_odd_rows(docs):
    model = toxicity.fit_rows(["you slime"] * 30 + ["fine day"] * 30, [1] * 30 + [0] * 30, (1, 1))
    assert toxicity.score_toxicity(docs, model).count() == len(TEXTS)


def edits(pattern, text):
    """The least edits by which the pattern occurs in the text."""
    cost = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(cost[j - 1] + (c != d), cost[j] + 1, now[j - 1] + 1))
        cost = now
    return min(cost)


def leaked(items, text, config):
    """The items of which the text holds a window, by aligning each window with the whole text."""
    plain = lambda t: " ".join((t or "").lower().split())
    out, said = set(), plain(text)
    for item, t in items:
        if not (t := plain(t)):
            continue
        if len(t) < config.least_chars:
            windows = re.search(rf"(?<![0-9a-z\u0080-\uffff]){re.escape(t)}(?![0-9a-z\u0080-\uffff])", said)
        else:
            windows = [t[a:b] for a, b in decontaminate.window_spans(np.frombuffer(t.encode(), np.uint8), config)]
            windows = {w for w in windows if edits(w, said) <= decontaminate.budget(len(w), config)}
        if windows:
            out.add(item)
    return sorted(out)


@pytest.mark.parametrize(("block_chars", "counted"), [(1 << 20, 1 << 21), (900, 50)])
def test_leaks_are_those_of_full_alignment(spark, monkeypatch, block_chars, counted):
    monkeypatch.setattr(decontaminate, "COUNTED", counted)
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    preamble = say(12)
    items = [*((k, say(18)) for k in range(4)), *((k, f"{preamble} {say(20)}") for k in range(4, 8)), (8, say(75)), (8, say(16)), (10, "short one"), (11, "Ab"), (9, None), (12, ""), (13, "  ")]
    texts = []
    for _ in range(30):
        whole = rng.choice(items[:9])[1]
        a = rng.choice([0, 0, rng.randrange(len(whole))])
        part = list(whole[a : rng.choice([len(whole), a + 130])])
        for _ in range(rng.choice([0, 0, 1, 3, 5, 12])):
            part[rng.randrange(len(part))] = rng.choice("xyz")
        texts.append(say(rng.randint(0, 40)) + " " + ("".join(part) if rng.random() < 0.7 else "") + " " + say(10) + rng.choice(["", " short  one", " shorts one", " ab ", " (Ab)", "\"short one\"?", " short onez"]))
    texts += [None, "", "ab", preamble, f"{preamble} " * 8, say(10)]
    config = decontaminate.LeakConfig(block_chars=block_chars)
    docs, benchmark = table(spark, texts, list(range(len(texts)))).withColumn("leaked_items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    flagged = decontaminate.flag_leaks(docs, benchmark, config)
    assert flagged.columns == docs.columns
    want = {k: leaked(items, t, config) for k, t in enumerate(texts)}
    assert sum(map(bool, want.values())) > 10
    assert {r.doc_id: r.leaked_items for r in flagged.collect()} == want
    index = decontaminate.BenchmarkIndex(decontaminate.windows_of([x for x in items if x[1]], config), config)  # in this process, where the small size holds
    here = index.find(*decontaminate.normalised(pa.array([t or "" for t in texts])))
    assert here[:, :2].tolist() == [[k, i] for k, x in want.items() for i in x]
    found = decontaminate.find_leaks(docs, benchmark, config).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, i) for k, x in want.items() for i in x]
    for r in found:
        part = " ".join((texts[r.doc_id] or "").lower().split())
        assert 0 <= r.start < r.end <= len(part) + 1
        assert r.end - r.start <= config.window + 6


def test_a_preamble_of_many_items_costs_no_more_than_its_windows():
    rng = random.Random(1)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    preamble = say(118)
    config = decontaminate.LeakConfig()
    index = decontaminate.BenchmarkIndex(decontaminate.windows_of([(k, preamble + say(200)) for k in range(50)], config), config)
    start = time.perf_counter()
    rows = index.find(*decontaminate.normalised(pa.array([preamble * 20])))
    assert time.perf_counter() - start < 5
    assert rows[:, 1].tolist() == list(range(50))


def test_near_equal_preambles_are_told_by_what_they_share():
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    preamble, config = say(20), decontaminate.LeakConfig()
    items = [(k, f"item {k * 7} of the list: {preamble} {say(20)}") for k in range(400)]
    index = decontaminate.BenchmarkIndex(decontaminate.windows_of(items, config), config)
    text = decontaminate.normalised(pa.array([f"{preamble} {say(5)} " * 13]))
    index.find(*text)
    start = time.perf_counter()
    rows = index.find(*text)
    assert time.perf_counter() - start < 1
    assert rows[:, 1].tolist() == list(range(400))


@pytest.mark.parametrize("letters", [(1, 3), (2, 9), (5, 14)])
def test_passages_of_thirteen_words_and_more_are_found(letters):
    """Excerpts from anywhere in long items, whatever their words' length, between other text; changed ones as far as edits allow."""
    rng, config = random.Random(3), decontaminate.LeakConfig()
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(*letters))) for _ in range(n))
    items = [(k, say(120)) for k in range(20)]
    index = decontaminate.BenchmarkIndex(decontaminate.windows_of(items, config), config)
    for words in (13, 16, 20, 25, 50):
        texts, want = [], []
        for _ in range(60):
            item, text = rng.choice(items)
            at = rng.randint(0, 120 - words)
            part = " ".join(text.split()[at : at + words])
            if len(part) >= 46:
                texts.append(f"{say(30)} {part} {say(30)}")
                want.append(item)
        rows = index.find(*decontaminate.normalised(pa.array(texts, pa.string())))
        assert all([k, i] in rows[:, :2].tolist() for k, i in enumerate(want))
        assert len(rows) == len(want)
    clean = index.find(*decontaminate.normalised(pa.array([say(200) for _ in range(50)])))
    assert not len(clean)


def test_leaks_of_several_blocks_keep_ids_and_rows(spark):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(k, say(30)) for k in range(12)] + [(50, "What is two plus two"), (51, "?!")]
    texts = [(None, items[3][1], 1), (None, items[3][1], 1), (7, items[5][1] + " ?!", 2), (7, "Q: What is two plus two? A: 4", 3), (8, "(what is two plus two)", 4), (8, "what is two plus twofold", 5), (9, None, 6), (9, "", 7)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, id int")
    got = decontaminate.flag_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), decontaminate.LeakConfig(block_chars=400))
    assert got.columns == ["doc_id", "text", "id", "leaked_items"]
    assert sorted((r.id, r.leaked_items) for r in got.collect()) == [(1, [3]), (1, [3]), (2, [5]), (3, [50]), (4, [50]), (5, []), (6, []), (7, [])]


@pytest.mark.parametrize("size", [3, 4096])
def test_exact_duplicates_of_odd_rows(docs, size):
    got = exact_dedup.exact_duplicates(docs, size).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    want = sorted((hashlib.sha256(low(t).encode()).hexdigest(), sum(low(t) == low(x) for x in TEXTS)) for t in TEXTS)
    assert sorted((r.text_sha256, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len({low(t) for t in TEXTS})


def test_license_notices_are_found_in_place(docs, spark):
    mit = license_scan.TEMPLATES["mit"]
    texts = [None, "", f"one two {mit} three", mit.replace("hereby", "now"), "the software is provided", mit.lower(), mit.replace(" of ", " * of "), f"{mit} x {license_scan.TEMPLATES['isc']}", "filler words " * 20_000 + mit]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = license_scan.scan_licenses(rows).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [[], [], ["mit"], ["mit"], [], ["mit"], ["mit"], ["mit", "isc"], ["mit"]]
    n = len(mit.split())
    assert (got[2].first_word, got[2].end_word, got[2].coverage) == ([2], [2 + n], [1.0])
    assert got[8].first_word == [40_000]
    assert license_scan.patience([1, 2, 3, 4], [1, 3, 4]) == [(0, 0), (2, 1), (3, 2)]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(row[j - 1] + 1 if x == y else max(row[j], now[-1]))
        row = now
    return row[-1]


def test_patience_gives_an_alignment_no_longer_than_the_longest():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < i2 and j < j2 for (i, j), (i2, j2) in zip(pairs[:-1], pairs[1:], strict=True))
        assert len(pairs) <= longest_common(a, b)
        once = list(dict.fromkeys(a))
        mixed = once[:]
        del mixed[len(mixed) // 2 : len(mixed) // 2 + 2]
        assert len(license_scan.patience(mixed, once)) == longest_common(mixed, once)  # words that occur once


def test_the_best_window_covers_no_less_than_windows_at_every_word():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    notices = {"a": " ".join(rng.choice(words) for _ in range(40)), "b": " ".join(words[:12]), "c": "w1 w2 w3 w4 w5"}
    t = license_scan.Templates(license_scan.LicenseConfig(templates=notices))
    found = 0
    for _ in range(300):
        k = rng.randrange(3)
        notice = t.words[k][:]
        for _ in range(rng.choice([0, 1, 3, 6])):
            at = rng.randrange(len(notice))
            notice[at : at + rng.randint(0, 1)] = [rng.choice([-1, rng.randrange(30)])] * rng.randint(0, 1)
            notice = notice or [0]
        other = lambda: [rng.choice([-1, -1, rng.randrange(30)]) for _ in range(rng.randint(0, 60))]
        text = np.array([*other(), *notice, *other(), *(notice if rng.random() < 0.3 else [])])
        n = len(t.words[k])
        want = max(len(license_scan.patience(text[p : p + n + 2].tolist(), t.words[k])) for p in range(len(text))) / n
        share, a, b = t.best(text, k)
        if want >= t.config.coverage:
            found += 1
            assert share >= t.config.coverage
            assert len(license_scan.patience(text[a:b].tolist(), t.words[k])) / n >= t.config.coverage
        assert share <= 1
        if share >= t.config.coverage:
            assert longest_common(text[a:b].tolist(), t.words[k]) / n >= share - 1e-9
    assert found > 60


def test_language_on_held_out_rows(spark):
    got = language.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_language_of_odd_rows(docs, spark):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = language.with_language(docs.withColumn("lang_pred", F.lit("old")), model).collect()
    assert len(got) == len(TEXTS)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if not (r.text or "").strip())
    assert language.language_spans(docs, model).count() > 0


def components(rows, k, num):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (c := len(sets[a] & sets[b])) and 100 * c >= num * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num", "block", "asks", "hot"), [(3, 90, 256, 1024, 12), (5, 80, 3, 2, 1)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, k, num, block, asks, hot):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ASKS", asks)
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmno")
    texts, passage = [None, "", "  "], [word() for _ in range(40)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 2, 5, 30, 150]))]
        for _ in range(rng.choice([1, 3, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w + passage[: rng.choice([0, 0, 30])]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    made = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard_join.JaccardConfig(words=k, num=num))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made.collect()} == components(rows, k, num)


def test_components_of_odd_rows(docs):
    got = jaccard_join.similar_components(docs).collect()
    assert len(got) == len(TEXTS)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_token_files_hold_the_tokenizers_ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.public_tokenizer())
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids(x)))
    got = sorted(token_files.token_files(docs).collect(), key=lambda r: r.start)
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(ids(x)), crc(x)) for x in TEXTS)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])


def test_an_id_and_a_text_that_repeat_are_dealt_out(spark, tmp_path):
    rows = [(7, f"word {k % 3}" if k % 2 else "same text") for k in range(4000)] + [(6, "x"), (8, None)]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "files"))
    assert max(x["n_docs"] for x in manifest) < 2000
    got = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [6, *[7] * 4000, 8]
    assert len({r.ids_crc32 for r in got}) == 6
    assert [r.start + r.n_tokens for r in got[:-1]] == [r.start for r in got[1:]]


def test_word_ids_are_the_tokenizers():
    encoder = token_files.WordEncoder(token_files.public_tokenizer())
    rng = random.Random(1)
    pool = [chr(x) for x in [*range(9, 128), *range(0xA0, 0x250), *range(0x300, 0x310), 0x3A3, 0x3C3, 0x130, 0x4E00, 0xAC00, 0x1100, 0x1161, 0x1F600, 0x2028, 0x85]]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice("abcDE ,.'?") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    flat, sizes = encoder.encode(pa.array(texts, pa.string()), 2)
    want = [[*encoder.tokenizer.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert sizes.tolist() == [len(x) for x in want]
    assert flat.tolist() == [i for x in want for i in x]


def test_toxic_runs_are_found_in_place(docs, empty):
    fine, bad = ["fine day to walk", "walk to the day", "the fine walk"], ["you slime", "slime you vermin", "vermin slime"]
    model = toxicity.fit_rows([f"{fine[k % 3]} {bad[k % 3] if k % 2 else ''}" for k in range(120)], [k % 2 for k in range(120)], (1, 1))
    text = "the  fine\nday slime vermin walk (slime) to"
    rows = docs.sparkSession.createDataFrame([(1, text, 0), (None, "slime", 0), (1, text, 0), (2, None, 0), (3, "", 0), (4, "fine walk", 0)], "doc_id long, text string, start int")
    got = sorted(((r.doc_id, text[r.start : r.end] if r.doc_id else "") for r in toxicity.toxic_spans(rows, model).collect()), key=str)
    assert got == sorted([(1, "slime vermin"), (1, "(slime)")] * 2 + [(None, "")], key=str)
    scored = toxicity.score_toxicity(rows, model).collect()
    assert sorted((str(r.doc_id), a, b) for r in scored for a, b in r.toxic_spans) == sorted((str(r.doc_id), r.start, r.end) for r in toxicity.toxic_spans(rows, model).collect())
    assert all(bool(r.toxic_spans) == (r.n_toxic_words > 0) for r in scored)
    assert all(r.toxic_spans == [] for r in toxicity.score_toxicity(rows, None).collect())
    assert toxicity.toxic_spans(rows, None).count() == 0
    assert toxicity.toxic_spans(empty, model).count() == 0


def test_one_text_of_a_repeated_id_is_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_rows", lambda texts, toxic, shares, config: seen.append(sorted(zip(texts, toxic, strict=True))))
    rows = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    toxicity.fit(rows, spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int"))
    assert seen == [[("a", 1), ("c", 0)]]


def test_languages_of_a_mixed_text_come_out_as_spans(spark, docs, empty):
    train = spark.createDataFrame([(k, t, lang) for k in range(40) for t, lang in (("the thing that they think with", "en"), ("слово и дело что было", "ru"), ("que los señores están aquí", "es"))], "doc_id long, text string, lang string")
    model = language.fit(train)
    text = "they think that the thing 12 , слово было дело 7 que los señores están"
    rows = spark.createDataFrame([(1, text, 1), (2, None, 1), (3, "", 1), (None, "the thing", 1)], "doc_id long, text string, first_word int")
    got = sorted((r.doc_id or 0, r.first_word, r.end_word, r.lang) for r in language.language_spans(rows, model).collect())
    assert [x[3] for x in got] == ["en", "en", "ru", "es"]
    assert got[0] == (0, 0, 2, "en")
    assert [x[1] for x in got[1:]] == [0, *(x[2] for x in got[1:3])]
    assert got[1][2] in (5, 6, 7)
    assert got[2][2] in (10, 11)
    assert got[3][2] == 15
    assert language.language_spans(rows, None).count() == 0
    assert language.language_spans(empty, model).count() == 0


def test_what_has_no_letter_has_no_language(spark):
    texts = ["½ ²", "Ⅷ ①", "12 _ 3", "½ a", "ß", "中", "̀", "ªx"]
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = spark.createDataFrame([(k, t, 42.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    got = language.with_language(rows, model, ("ampline_lang", "ampline_score")).orderBy("doc_id").collect()
    assert [r.ampline_lang == "und" for r in got] == [True, True, True, False, False, False, True, False]
    assert all(r.score == 42.0 and (r.ampline_score == 0) == (r.ampline_lang == "und") for r in got)
