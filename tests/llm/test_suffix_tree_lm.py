import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.suffix_tree_lm import Tree, _coded, _decoded, score_texts


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows, tree=Tree(), held=is_held):
    """The tree by dictionaries: counts of all contexts, states from short to
    long, and every token walked down from the root."""
    texts = [tokens(t) for _, t in rows]
    learned = [own for (d, _), own in zip(rows, texts) if not held(d)]
    counts = Counter(w for own in learned for w in own)
    n, v = sum(counts.values()), len(counts)
    after = defaultdict(Counter)
    for own in learned:
        for i, w in enumerate(own):
            for d in range(1, min(tree.depth, i) + 1):
                after[tuple(own[i - d : i])][w] += 1
    states = {()}

    def p(context, w):
        if not context:
            return (counts[w] + 1) / (n + v + 1)
        return (after[context][w] + tree.pseudo * p(context[1:], w)) / (sum(after[context].values()) + tree.pseudo)

    for context in sorted(after, key=len):
        seen = sum(after[context].values())
        if context[1:] in states and seen >= tree.least:
            gain = 0
            for w, c in after[context].items():
                q = p(context[1:], w)
                gain += c * math.log((c - 1 + tree.pseudo * q) / (seen - 1 + tree.pseudo) / q)
            if gain >= tree.min_gain:
                states.add(context)
    out = []
    for (doc_id, _), own in zip(rows, texts):
        score = 0.0
        for i, w in enumerate(own):
            d = 0
            while d < min(tree.depth, i) and tuple(own[i - d - 1 : i]) in states:
                d += 1
            score += math.log10(p(tuple(own[i - d : i]), w))
        out.append((doc_id, held(doc_id), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), score))
    return out, len(states)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("tree,chunk", [(Tree(), 1 << 24), (Tree(), 20_000), (Tree(4, 2, 2.0, 1.0), 60_000), (Tree(1, 5, 4.0, 3.0), 5000), (Tree(0), 30_000)])
def test_against_dictionaries(odd, documents, same, tree, chunk):
    """Whatever the chunks, the tree is the same one."""
    for docs in (odd, documents.repartition(3)):
        got = [tuple(r) for r in score_texts(docs, tree=tree, chunk_bytes=chunk).collect()]
        want, states = brute(pairs(docs), tree)
        same(got, want, places=5)
        assert docs is odd or states > (30 if tree.depth else 0)


def test_empty_and_nothing_to_learn_from(odd, none, spark):
    assert score_texts(none).count() == 0
    got = score_texts(odd, held_out="true").collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
    assert len(got) == odd.count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("chunks_")]


def test_held_out_texts_beat_the_baseline(spark):
    """Over what was not learned from, words and their histories say more than
    words alone."""
    got = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    for held in (True, False):
        own = [r for r in got if r.held_out == held]
        assert sum(r.score for r in own) > 0.99 * sum(r.base_score for r in own)


def test_more_of_the_same_keeps_every_state(spark):
    """Nothing that was kept is lost when the corpus grows beside it."""
    r = np.random.default_rng(2)
    say = lambda n, tag: " ".join(f"{tag}{i}" for i in r.integers(0, 400, n))
    own = [(i, "the cat sat on the mat and " + say(20, "a")) for i in range(40)]
    more = own + [(100 + i, say(300, f"t{i % 9}x")) for i in range(300)]
    before, after = ({x.doc_id: x.score - x.base_score for x in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()} for rows in (own, more))
    assert all(after[i] > 0.8 * before[i] > 0 for i in range(40))


def test_chunks_with_nothing_to_ask(spark, same):
    """Some chunks end early in the tree, others do not."""
    rows = [(1, "a"), (2, None), (3, "x y z " * 30), (4, "x y z " * 30), (5, "lone words here"), (6, ""), (7, "x y z")]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same([tuple(r) for r in score_texts(made, chunk_bytes=1).collect()], brute(rows)[0], places=5)


def test_keys_round_trip():
    r = np.random.default_rng(1)
    for keys in (np.empty(0), r.integers(0, 1 << 63, 500), r.integers(0, 1 << 20, 500), np.array([0, 0, 5, (1 << 40) - 1 + 5]), np.array([1 << 41])):
        keys = np.sort(keys.astype(np.uint64))
        assert (_decoded(_coded(keys)) == keys).all()
