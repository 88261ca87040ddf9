"""Spelling variants against brute force, and the bounds that the gram index rests on."""

import random
import re
import zlib
from collections import Counter

import pytest

from parley.llm.spelling_variants import MARK, Grams, frequent_grams, near_words, roots, spelling_variants, word_counts

from .test_llm import docs, edge_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n, out = counted(rows), []
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v.encode())) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def vocabulary(seed, size, alphabet="abcé"):
    r = random.Random(seed)
    found = set()
    while len(found) < size:
        word = "".join(r.choice(alphabet) for _ in range(r.randrange(5, 13)))
        found.add(word)
        at = r.randrange(len(word))
        found |= {word[:at] + word[at + 1 :], word[:at] + r.choice(alphabet) + word[at:], word[:at] + r.choice(alphabet) + word[at + 1 :]}
    return sorted(found)


@pytest.mark.parametrize("grams", [{}, {"least": 3, "longest": 8}, {"least": 1 << 40}, {"least": 0, "most": 50}])
def test_variants_against_brute_force(spark, grams):
    r = random.Random(4)
    some = vocabulary(5, 150)
    texts = [" ".join(r.choice(some) if r.random() < 0.7 else some[int(r.paretovariate(0.6)) % len(some)] for _ in range(400)) for _ in range(6)]
    texts += [*edge_texts(), "Straße STRASSE strasse Ärger ärger ÄRGER×ärger÷Ærger " * 3, "abcde" * 40 + " " + "abcde" * 40 + "x"]
    rows = list(enumerate(texts))
    got = spelling_variants(docs(spark, *texts).repartition(3), **grams)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(x) for x in got.collect()), key=lambda x: x[0]) == brute(rows)


def test_missing_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "spelling spellin"), (1, "spelling"), (1, "spelling spellin spellin"), (2, None), (3, "")]
    table = spark.createDataFrame(rows, "doc_id int, text string")
    assert sorted(tuple(x) for x in spelling_variants(table).collect()) == brute(rows)
    assert spelling_variants(table.limit(0)).collect() == []
    assert word_counts(table.where("doc_id > 1")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_near_words_share_a_rare_gram(seed):
    r = random.Random(seed)
    some = vocabulary(seed, 400, "ab" if seed % 2 else "abcdé")
    counts = Counter(f"{MARK}{w}{MARK}"[i : i + q] for w in some for q in range(2, 8) for i in range(len(w) + 3 - q))
    for least, longest in ((0, 7), (20, 5), (10**6, 4)):
        grams = Grams({g: n for g, n in counts.items() if n > least}, 2, longest)
        for word in some:
            at, letter = r.randrange(len(word)), r.choice("abz")
            for other in (word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word + letter, letter + word, word[:at] + letter + word[at + 1 :]):
                if other == word:
                    continue
                length = min(len(word), len(other))
                mine, theirs = grams.decompose(word, length), grams.decompose(other, length)
                kept = sum((Counter(mine) & Counter(theirs)).values())
                assert kept >= len(mine) - grams.affected(mine, len(word)) > 0 and kept >= len(theirs) - grams.affected(theirs, len(other)) > 0
                assert any(c == length for c, _ in set(grams.lists(word)) & set(grams.lists(other))), (word, other)


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(w, 3) for w in vocabulary(9, 2000, "abcdefgh")], "word string, n long")
    for most in (20, 200, 2000):
        assert 0 < len(frequent_grams(words, 0, most, 2, 6)) <= most


def test_hot_list_finds_all_links(spark, tmp_path):
    words = spark.createDataFrame([(f"prefixed{chr(97 + k // 26)}{chr(97 + k % 26)}suffix", 3) for k in range(400)], "word string, n long")
    found = near_words(words, str(tmp_path)).count()
    names = [r.word for r in words.collect()]
    assert found == sum(one_edit(a, b) for a in names for b in names)


def test_roots_of_long_chains(spark, tmp_path):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(100)] + [(f"x{k}", "w50") for k in range(50)], "word string, form string")
    assert {r.root for r in roots(forms, str(tmp_path)).collect()} == {"w100"}
