import public_tokenizers
from tokenizers import Tokenizer

from lodemap.llm.token_count import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "  ", "a  b", "a \n b\n\n c", " x    y", "a\x1cb \x1d c", "<|endoftext|> a<|endoftext|>b", "it's  we'll\t\tx ", "\u3000 z", "\x85 b\x85",
    "a" * 3000 + " b", "x\u00a0\u00a0y \u2028 z", "\n\n\n", "9 999 9,9.9 !!", "\U0001f600 \U0001f600\u200d",
]


def test_lengths_are_the_librarys(odd_rows):
    plain = Tokenizer.from_file(PATH)
    texts = ODD + [t or "" for _, t in odd_rows]
    want = [len(plain.encode(t, add_special_tokens=False)) for t in texts]
    assert Counter(PATH).lengths(texts) == want
    assert Counter(PATH, batch_bytes=50, remembered=3).lengths(texts) == want


def test_rows(spark, make, odd_rows):
    got = token_counts(make(odd_rows), PATH, limit=100).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for i, t in odd_rows:
        n = len(plain.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 100))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(make([]), PATH).count() == 0
