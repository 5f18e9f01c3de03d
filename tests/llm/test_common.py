import numpy as np

from lodemap.llm.common import ALNUM, LOWER, blocks, gram_hashes, word_hashes


def test_hashes_follow_words_wherever_they_stand(odd_rows):
    texts = [t for _, t in odd_rows]
    for translate in (LOWER, ALNUM):
        seen = {}
        for limit in (1 << 20, 500):
            for first, raws in blocks(texts, limit):
                hashes, counts = word_hashes(raws, translate)
                words = [w for raw in raws for w in raw.translate(translate).split()]
                assert counts.tolist() == [len(raw.translate(translate).split()) for raw in raws]
                for w, h in zip(words, hashes.tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_prefixes():
    hashes, counts, four = word_hashes([b"abcdef abcdxy abc", b"", b"abcd"], LOWER, (4,))
    assert counts.tolist() == [3, 0, 1]
    assert four[0] == four[1] == four[3] == hashes[3] and four[2] == hashes[2] and hashes[0] != hashes[1]


def test_grams_and_empty_input():
    hashes, _ = word_hashes([b"a b c a b c"])
    grams = gram_hashes(hashes, 3)
    assert grams[0] == grams[3] and len(set(grams.tolist())) == 3
    assert len(gram_hashes(hashes, 7)) == 0 and not len(word_hashes([])[0]) and word_hashes([b"", b" "])[1].tolist() == [0, 0]
    assert np.array_equal(word_hashes([b"x" * 70 + b" y"])[0], word_hashes([b"y " + b"x" * 70])[0][::-1])
