"""Groups of near copies around and beside hubs, against every pair."""

import random

import pytest

from tagloom.llm.ngram_join import similar_components


def grams(text, size):
    words = text.split()
    return {tuple(words[i: i + size]) for i in range(max(1, len(words) - size + 1))}


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"x{rnd.random()}"
    return out


def brute_force(texts, size, percent):
    sets = {i: grams(t, size) for i, t in texts.items()}
    of = {i: i for i in texts}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                of[high] = low
    return {i: top(i) for i in texts}


@pytest.mark.parametrize("size, percent, edits", [(3, 90, 5), (5, 80, 7)])
def test_families_against_every_pair(spark, size, percent, edits):
    rnd = random.Random(size)
    base = [f"w{i}" for i in range(130)]
    texts = [base]
    texts += [edited(rnd, base, rnd.randint(0, edits)) for _ in range(90)]
    # some beyond the threshold of the base, linked among themselves
    far = edited(rnd, base, edits)
    texts += [edited(rnd, far, rnd.randint(0, 2)) for _ in range(30)]
    far = edited(rnd, base, 2 * edits)
    texts += [edited(rnd, far, rnd.randint(0, 2)) for _ in range(30)]
    # other lengths: cut, extended, the base twice, a shared passage
    texts += [base[: rnd.randint(100, 130)] for _ in range(15)]
    texts += [base + [f"y{i}" for i in range(rnd.randint(1, 25))] for _ in range(15)]
    texts += [base[:40] + [f"z{k}.{i}" for i in range(60)] for k in range(20)]
    texts += [[f"v{k}.{i}" for i in range(50)] for k in range(10)]
    rnd.shuffle(texts)
    texts = {i: " ".join(words) for i, words in enumerate(texts)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {
        r.doc_id: r.component_id
        for r in similar_components(docs, size=size, percent=percent).collect()
    }
    want = brute_force(texts, size, percent)
    assert got == want
    assert len(set(want.values())) > 40
