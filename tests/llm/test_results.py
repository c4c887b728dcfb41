"""The operators against brute force, exact round trips and held-out labels."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from corpus import changed, prose, stored
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import fingerprints as fp
from barloom.llm.alignment import _in_band, banded_distance
from barloom.llm.common import fold, hash_words
from barloom.llm.decontamination import Index, contamination, item_words
from barloom.llm.language_model import _from_gaps, _gaps, _numbers, _planes, _totals, aside, lm_scores, prior_of_failure
from barloom.llm.near_dup import components, near_duplicates
from barloom.llm.neighbours import edited
from barloom.llm.packing import minimum_bin_slack, pack
from barloom.llm.quality import quality_scores
from barloom.llm.sharding import communication_matrix, shard, shard_sizes
from barloom.llm.token_ids import document_ids
from barloom.llm.token_output import feistel, read_token_shards, write_token_shards
from barloom.llm.toxicity import toxicity_scores
from barloom.llm.url_filter import judge_urls


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=16), st.lists(st.sampled_from("abc"), max_size=16), st.integers(0, 16))
def test_banded_alignment(a, b, limit):
    real = distance(a, b)
    assert banded_distance(a, b, limit) == (real if real <= limit else None)
    if b and abs(len(a) - len(b)) <= limit:
        cost = _in_band(a, b, limit)
        assert cost >= real and (real > limit or cost == real)


def test_word_hashes():
    texts = ["A b\tc", "", " a\x0bB  ", "c" * 3_000_000 + " b"]
    hashes, starts = hash_words(texts, lower=True)
    assert starts.tolist() == [0, 3, 3, 5, 7]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[4] == hashes[6] and len(set(hashes.tolist())) == 4


@pytest.fixture(scope="module")
def family(spark, tmp_path_factory):
    """Families of near copies, exact copies, and texts that share a passage only."""
    rows, n = [], itertools.count()
    passage = prose(999, 40)
    for f in range(12):
        text = prose(f, 90 + 10 * f)
        rows += [(next(n), text), (next(n), text)] + [(next(n), changed(text, 0.06, 100 * f + k)) for k in range(4)]
    rows += [(next(n), prose(500 + k, 120) + "\n" + passage) for k in range(10)]
    random.Random(3).shuffle(rows)
    return stored(spark, str(tmp_path_factory.mktemp("family")), rows, "doc_id long, text string"), dict(rows)


def test_near_duplicates_equal_all_pairs(family):
    docs, texts = family
    words = {d: t.split() for d, t in texts.items()}
    label = {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in itertools.combinations(sorted(texts), 2):
        limit = int(0.2 * max(len(words[a]), len(words[b])))
        if banded_distance(words[a], words[b], limit) is not None:
            low, high = sorted((root(a), root(b)))
            label[high] = low
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert found == {d: root(d) for d in texts} and len(set(found.values())) == 22


def test_family_whose_members_are_near_the_original_only(spark, tmp_path):
    # two variants differ from each other by up to 26 %, so only links with the original join them
    original = prose(77, 200)
    rows = [(0, original)] + [(k, changed(original, 0.13, 900 + k)) for k in range(1, 301)]
    found = near_duplicates(stored(spark, tmp_path, rows, "doc_id long, text string"), sketches=96).collect()
    assert len(found) == 301 and {r["class_id"] for r in found} == {0}


def test_near_duplicates_at_the_limit_of_edits(spark, tmp_path):
    rows, draw = [], random.Random(8)
    for pair, n in enumerate([200] * 60 + [15] * 60 + list(range(5, 15)) * 4):
        words = [f"w{draw.randrange(10**9)}" for _ in range(n)]
        other = list(words)
        for at in [n // 2] if n < 10 else draw.sample(range(n), n // 5):
            other[at] = f"x{draw.randrange(10**9)}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(stored(spark, tmp_path, rows, "doc_id long, text string")).collect()}
    joined = [found[2 * pair + 1] == 2 * pair for pair in range(160)]
    assert sum(joined[:60]) >= 54 and sum(joined[60:120]) >= 54 and all(joined[120:])


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102)]
    found = {r["v"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def plain_backoff(texts, held, order):
    """Counts of all n-grams in training, and the probability of a word after a history, by recursion."""
    count = collections.Counter()
    for d, t in texts.items():
        ws = ["<s>", *t.lower().split(), None]
        for n in range(1, order + 1):
            for k in range(1 if n == 1 else 0, len(ws) - n + 1):
                count[tuple(ws[k : k + n])] += not held[d]
    count = collections.Counter({g: c for g, c in count.items() if c})
    ones = {g[0]: c for g, c in count.items() if len(g) == 1}
    total, types = sum(ones.values()), len(ones)
    once, twice = sum(c == 1 for c in ones.values()), sum(c == 2 for c in ones.values())
    off = once / (once + 2 * twice) if once and twice else 0.5
    prior = {}
    for n in range(1, order):
        by_size = collections.defaultdict(list)
        for g, c in count.items():
            if len(g) == n:
                by_size[c.bit_length()].append(c)
        novel = sum(c == 1 and len(g) == n + 1 for g, c in count.items())
        prior[n] = prior_of_failure([(sum(cs), len(cs)) for cs in by_size.values()], novel)
    followed = lambda h: ones[None] if h == ("<s>",) else count[h]

    def p(h, w):
        if not h:
            return (ones[w] - off if w in ones else off * types) / total
        if not followed(h):
            return p(h[1:], w)
        a = aside(followed(h), prior[len(h)])
        return (count[*h, w] + a * p(h[1:], w)) / (followed(h) + a)

    return count, ones, total, p


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_equals_plain_backoff(family, order):
    docs, texts = family
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    count, ones, total, p = plain_backoff(texts, held, order)
    rows = lm_scores(docs, fold("doc_id", 10) == 0, order, block_bytes=4000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = ["<s>", *texts[r["doc_id"]].lower().split(), None]
        base = sum(math.log10((ones.get(w, 0) + 0.1) / (total + 0.1 * (len(ones) + 1))) for w in ws[1:])
        score = sum(math.log10(p(tuple(ws[max(0, k - order + 1) : k]), ws[k])) for k in range(1, len(ws)))
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(ws) - 1, total)
        assert r["n_known"] == sum(w in ones for w in ws[1:])
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] == pytest.approx(score, abs=1e-6)
    # the weights of a state sum to 1 over all known words and the unknown class
    histories = [("<s>",), *[g for g in count if len(g) == order - 1 and None not in g]][:: max(1, len(count) // 50)]
    for h in histories:
        h = h[len(h) - order + 1 :] if order > 1 else ()
        assert sum(p(h, w) for w in [*ones, "never seen"]) == pytest.approx(1)


def test_counts_and_hashes_keep_all_64_bits():
    numbers = np.array([0, 1, 255, 1 << 32, (1 << 40) + 7, (1 << 63) + 1, (1 << 64) - 1], np.uint64)
    assert (_numbers(_planes(numbers)) == numbers).all() and (_from_gaps(_gaps(numbers)) == numbers).all()
    frame = pd.DataFrame(
        {"block": [0, 1], "bucket": 0, "gram": 1, "hashes": [_gaps(numbers[:2])] * 2, "n": [_planes(np.array([1, 1 << 32], np.uint64))] * 2}
    )
    found = _totals(frame)
    assert [_numbers(x).tolist() for x in found["n"][:2]] == [[2, 1 << 33]] * 2
    assert found[found["block"] == -1][["digits", "tokens", "types", "once", "twice"]].values.tolist() == [[2, 2, 1, 0, 1], [34, 1 << 33, 1, 0, 0]]


def test_decontamination_finds_planted_edits(spark, tmp_path):
    draw = random.Random(8)
    items = [(k, prose(1000 + k, 15 + k)) for k in range(40)]
    docs, planted = [], set()
    for k, text in items:
        words = [w for w in text.split()]
        for _ in range(int(0.1 * len(words))):
            words[draw.randrange(len(words))] = f"other{draw.random()}"
        docs.append((k, prose(5000 + k, 80) + " " + " ".join(words) + " " + prose(6000 + k, 40)))
        planted.add((k, k))
    docs += [(100 + k, prose(7000 + k, 200)) for k in range(40)]
    table = stored(spark, tmp_path, docs, "doc_id long, text string")
    found = contamination(table, spark.createDataFrame(items, "item_id long, text string"), block_items=15).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(pairs & planted) >= 0.95 * len(planted)
    for r in found:  # every row is right: a window of the text is within the allowed edits of the item
        item, words = item_words(dict(items)[r["item_id"]]), item_words(dict(docs)[r["doc_id"]])
        at = r["start"]
        best = min(distance(item, words[at : at + n]) for n in range(max(0, len(item) - 8), len(item) + 9))
        assert best == r["edits"] <= 0.2 * len(item)


def test_recall_at_the_limit_of_edits():
    items = [(k, prose(1000 + k, 15 + k)) for k in range(40)]
    index, rng, hit = Index(items, 0.8, 0.95), np.random.default_rng(1), 0
    for k, item in enumerate(index.items):
        window = index._edited(item, index.allowed[k], rng)
        stream = np.r_[np.zeros(20, np.int32), window, np.zeros(30, np.int32)]
        hit += any(i == k for _, i in index.candidates(stream))
    assert hit >= 0.9 * len(items)


def test_recall_of_long_items_at_the_limit_of_edits():
    items = [(k, prose(1500 + k, n)) for k, n in enumerate([250] * 20 + [500] * 20)]
    index, rng, hit = Index(items, 0.8, 0.95), np.random.default_rng(1), [0, 0]
    for k, item in enumerate(index.items):
        around = rng.integers(1, len(index.vocabulary) + 1, 60, dtype=np.int32)
        stream = np.r_[around[:20], index._edited(item, index.allowed[k], rng), around[20:]]
        hit[k >= 20] += any(i == k for _, i in index.candidates(stream))
    assert min(hit) >= 17


def test_packing_covers_every_id_once(spark, tmp_path):
    rows = [(k, prose(k, 5 + 37 * k % 400)) for k in range(120)] + [(500, prose(4, 3000)), (501, None)]
    texts = dict(rows)
    pieces = pack(stored(spark, tmp_path, rows, "doc_id long, text string"), window=512).toPandas()
    for d, part in pieces.sort_values("start").groupby("doc_id"):
        ids = document_ids(texts[d])
        assert part["start"].tolist() == [0, *part["length"].cumsum()[:-1]] and part["length"].sum() == len(ids)
        assert part["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part["start"], part["length"])]
    fills = pieces.groupby("sequence_id")["length"].sum()
    assert fills.max() <= 512 and (512 - fills).sum() <= 0.01 * fills.sum() + 512
    for _, part in pieces.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]]


def test_ids_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [prose(1, 300), "", "a<|endoftext|><|endoftext|>\n<|endoftext> b <|endoftext|>", "<|endoftext|> it's  \n\n  a\ttest é你\U0001f600 123!!", "A" * 300]:
        assert document_ids(text).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 6), max_size=8))
def test_first_window_is_the_fullest_with_its_seed(counts):
    plan = minimum_bin_slack(counts, 12)
    used = collections.Counter()
    for members, repeats in plan:
        assert sum(length * n for length, n in members) <= 12 and repeats > 0
        for length, n in members:
            used[length] += n * repeats
    assert used == collections.Counter(counts)
    if plan:
        left = list(collections.Counter(counts).elements())
        seed = max(left)
        left.remove(seed)
        sums = {0}
        for x in left:
            sums |= {s + x for s in sums if s + x + seed <= 12}
        assert sum(length * n for length, n in plan[0][0]) == seed + max(sums)


def test_token_shards_read_back(spark, tmp_path):
    rows = [(k, prose(k, 20 + 31 * k % 300)) for k in range(60)]
    docs = stored(spark, tmp_path, rows, "doc_id long, text string")
    shards = write_token_shards(docs, ids_per_record=128, records_per_shard=16)
    records = {r["slot"]: r["ids"] for r in read_token_shards(spark, shards).collect()}
    index = shards.index.collect()
    assert sorted(records) == list(range(shards.sequences)) and all(len(x) == 256 for x in records.values())
    stream = {}
    for r in index:
        ids = np.frombuffer(records[r["slot"]], "<u2")
        assert ids[-1] == 1 and not ids[r["n_ids"] : -1].any()
        assert zlib.crc32(ids[: r["n_ids"]].tobytes()) == r["ids_crc32"]
        stream[r["sequence"]] = ids[: r["n_ids"]]
    joined = np.concatenate([stream[k] for k in sorted(stream)])
    want = collections.Counter(document_ids(t).astype("<u2").tobytes() for _, t in rows)
    ends = np.flatnonzero(joined == 1)
    got = collections.Counter(x.tobytes() for x in np.split(joined, ends + 1) if len(x))
    assert got == want
    late = {r["slot"] for r in read_token_shards(spark, shards, 21).collect()}
    assert late == set(range(21, shards.sequences))


@pytest.mark.parametrize("domain", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(domain):
    assert sorted(feistel(np.arange(domain), domain, 5).tolist()) == list(range(domain))


def test_edited_texts_and_homomorphic_sums(spark, tmp_path):
    rows = [(k, prose(k, 5 + 11 * k % 90) if k % 7 else "") for k in range(50)]
    table = stored(spark, tmp_path, rows, "doc_id long, text string")
    order = sorted(rows, reverse=True)
    want = {}
    for i, (d, text) in enumerate(order):
        half = len(text) // 2
        want[d] = text[: len(text) - half] + order[(i + 1) % len(order)][1][:half]
    assert {r["doc_id"]: r["edited"] for r in edited(table).collect()} == want
    # order does not matter, and a paragraph is inserted by adding its vector
    lines = [prose(k, 12) for k in range(6)]
    texts = [(0, "\n".join(lines)), (1, "\n".join(reversed(lines))), (2, "\n".join(lines[:-1])), (3, lines[-1])]
    found = {r["k"]: r for r in fp.fingerprint_rows(spark.createDataFrame(texts, "k long, t string"), ["k"], "t").collect()}
    sums = [*fp.LANE_NAMES, *fp.WORD_NAMES, "units"]
    assert all(found[0][c] == found[1][c] == found[2][c] + found[3][c] for c in sums)
    assert any(found[0][c] != found[2][c] for c in fp.LANE_NAMES)


def test_communication_matrix_sums():
    sent = [7, 0, 13, 100, 1]
    matrix = communication_matrix(sent, shard_sizes(sum(sent), 6), 3)
    assert matrix.sum(axis=1).tolist() == sent and matrix.sum(axis=0).tolist() == shard_sizes(sum(sent), 6)


def test_shards_are_exact_and_reproducible(spark, tmp_path):
    rows = [(k, f"t{k % 7}") for k in range(997)]
    table = stored(spark, tmp_path, rows, "doc_id long, text string")
    found = shard(table, 10, rows_per_block=20).toPandas()
    assert sorted(found["doc_id"]) == list(range(997))
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part))) and len(part) in (99, 100)
    again = shard(table, 10, rows_per_block=20).toPandas()
    assert found.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    # neither shard nor slot follows the id
    assert abs(np.corrcoef(found["doc_id"], found["slot"] + 100 * found["shard"])[0, 1]) < 0.12


def test_quality_on_held_out_labels(spark, tmp_path):
    junk = lambda k: " ".join(f"{w}!!" for w in prose(k, 60).upper().split())
    rows = [(k, junk(k) if k % 5 == 0 else prose(k, 60), "en", f"s{k % 3}") for k in range(400)]
    docs = stored(spark, tmp_path, rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(200)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["accepted"] for r in quality_scores(docs, labels).collect()}
    assert all(scores[k] == (k % 5 != 0) for k in range(200, 400))


def test_sparse_sites_shrink_further(spark):
    from barloom.llm.quality import site_posteriors

    rows = [("big", "p", 0.2)] * 200 + [("small", "p", 0.2)] * 2 + [("rest", "p", 0.9)] * 300
    found = {r["host"]: r for r in site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    rate = found["big"]["global_rate"]
    assert abs(found["big"]["host_posterior"] - 0.2) < abs(found["small"]["host_posterior"] - 0.2)
    assert 0.2 < found["small"]["host_posterior"] < rate


def test_toxicity_on_held_out_labels(spark, tmp_path):
    bad = ["idiot", "moron", "vequxa", "vequrr", "vequlo", "vequti"]
    rows = [(k, prose(k, 50) + (f" you {bad[k % 6]} " + prose(k + 1, 5) if k % 4 == 0 else "")) for k in range(600)]
    docs = stored(spark, tmp_path, rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    scores = toxicity_scores(docs, labels, fold("doc_id", 4) != 2).withColumn("held_out", fold("doc_id", 4) == 2)
    wrong = scores.where("held_out").where(F.col("predicted") != (F.col("doc_id") % 4 == 0).cast("int"))
    assert wrong.count() <= 2


def test_link_graph_blocks_what_links_to_the_blocked(spark):
    pages = [
        (1, "http://bad.net/es/1", ""),
        (2, "http://near.org/x", '<a href="http://bad.net/es/1">x</a>'),
        (3, "http://far.org/x", '<a href="/own">x</a>'),
        (4, "http://good.com/x", '<a href="https://liked.org/">x</a>'),
        (5, "http://liked.org/", ""),
        (6, "http://WWW.example.com/en/1?q#f", ""),
        (7, "http://example.com/en/1", ""),
    ]
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert found[1] == ("net/es/", "block") and found[2] == (None, "block") and found[3] == (None, "allow")
    assert found[4] == ("com/", "allow") and found[5] == (None, "allow")
    assert found[6] == ("www.example.com/en/", "allow") and found[7] == ("example.com/en/", "block")


def test_digest_of_edited_text(spark):
    import __spark_entry__ as contract

    rows = contract.queries()["op6_multiset_hash"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        texts[d, "edited"] = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    assert all(r["edited_sha256"] == texts[r["doc_id"], "edited"] for r in rows)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.9 * len(rows)
