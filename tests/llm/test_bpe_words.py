"""The pair index over many words at once: the library's ids, at about the CPU of the library's call for each word."""

import json
import random
import time
import tracemalloc

import public_tokenizers
from tokenizers import Tokenizer

from opsweave.llm import bpe

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def made_words(count):
    rng = random.Random(5)
    kinds = (
        lambda: "".join(rng.choices(LETTERS, k=rng.randrange(1, 14))),
        lambda: rng.choice("ab!=-") * rng.randrange(1, 90),
        lambda: "".join(rng.choices(["the", "ing", "tion", "an", "or", "é", "я", "漢", "😀"], k=rng.randrange(1, 9))),
        lambda: "".join(rng.choices(LETTERS, k=rng.randrange(50, 300))),
    )
    return ["", *(rng.choices(kinds, (20, 1, 6, 1))[0]() for _ in range(count))]


def test_words_together_as_one_by_one():
    path = public_tokenizers.path(bpe.VOCABULARY)
    words = made_words(20_000)
    index = bpe.PairIndexEncoder(path)
    want = bpe.LibraryEncoder(path).encode_words(words)
    assert index.encode_words(words) == want
    assert [index._encode_long(w.encode()) for w in words if w] == [x for w, x in zip(words, want) if w]
    assert index.encode_words([]) == [] and index.encode_words([""]) == [b""]


def test_a_pair_of_lower_rank_that_a_merge_makes_goes_first(tmp_path):
    """A token with two origins: x + yz comes before xy + z, and a pair with xyz lies between them."""
    with open(public_tokenizers.path(bpe.VOCABULARY), encoding="utf-8") as file:
        spec = json.load(file)
    letters = bpe.byte_alphabet()
    merges = [["x", "yz"], ["xyz", "q"], ["x", "y"], ["xy", "z"], ["q", "xy"], ["xyzq", "xyzq"], ["z", "x"]]
    tokens = [*letters, *(c + "</w>" for c in letters), "yz", *("".join(m) for m in merges)]
    spec["model"] |= {"vocab": {t: i for i, t in enumerate(dict.fromkeys(tokens))}, "merges": merges}
    spec["added_tokens"] = []
    path = str(tmp_path / "made.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(spec, file)
    rng = random.Random(2)
    words = ["".join(rng.choices("xyzq", k=rng.randrange(1, 60))) for _ in range(3_000)] + ["xyzq" * 15 + "x", "xyz" * 40]
    model = Tokenizer.from_file(path).model
    want = [bpe.array("I", [t.id for t in model.tokenize(w)]).tobytes() for w in words]
    index = bpe.PairIndexEncoder(path)
    assert index.singly.any()
    assert index.encode_words(words) == want
    assert [index._encode_long(w.encode()) for w in words] == want


def test_new_words_cost_little_more_than_a_call_each():
    """When it went pair by pair, the index took more than three times the CPU of one call of the library for each word."""
    path = public_tokenizers.path(bpe.VOCABULARY)
    words = [w for w in made_words(40_000) if len(w) < 40]
    took = {}
    for kind in (bpe.PairIndexEncoder, bpe.LibraryEncoder):
        worker = kind(path)
        worker.encode_words(words[:100])
        runs = []
        for _ in range(3):
            start = time.process_time()
            worker.encode_words(words)
            runs.append(time.process_time() - start)
        took[kind] = min(runs)
    assert took[bpe.PairIndexEncoder] < 2 * took[bpe.LibraryEncoder]


def test_the_vocabulary_is_read_once_by_a_worker(monkeypatch):
    """Words are dropped at the end of a task; the arrays of the vocabulary stay."""
    made = []
    whole = bpe.PairIndexEncoder.__init__
    monkeypatch.setattr(bpe.PairIndexEncoder, "__init__", lambda self, path: made.append(path) or whole(self, path))
    bpe._pair_index.cache_clear()
    for _ in range(3):
        bpe.encoder.cache_clear()
        worker = bpe.encoder("index")
        assert not worker.parts.now and list(worker.encode([b"one word"])) == list(bpe.encoder("library").encode([b"one word"]))
    assert len(made) == 1


def test_a_part_that_recurs_is_no_object_of_its_own():
    """Arrow numbers the parts of a batch; when each was split off and looked up by itself, 400,000 of them took 68 MB."""
    rng = random.Random(3)
    text = " ".join(rng.choices(made_words(200), k=400_000)).encode()
    worker = bpe.encoder("index")
    list(worker.encode([text[:10_000]]))
    tracemalloc.start()
    (ids,) = worker.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == next(bpe.encoder("library").encode([text]))
    assert peak < len(ids) + 2_000_000


def test_caches_that_turn_over_and_batches_of_any_size(monkeypatch):
    """Words that are dropped and asked for again, parts at both ends of a text, nulls and empty texts in a batch."""
    rng = random.Random(4)
    words = [w for w in made_words(3_000) if w] + ["<|endoftext|>", "It's", "x<|endoftext|>y", "a\x1cb", "ΑΣ", "e\u0301"]
    texts = [None, "", " ", *(rng.choice(["", " ", "\n\t"]) + rng.choice([" ", "\n", "\x0b\x0c\r"]).join(rng.choices(words, k=rng.randrange(60))) for _ in range(400)), None, " "]
    data = [t if t is None else t.encode() for t in texts]
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    want = [bpe.array("I", library.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
    for limit, size in ((0, 0), (50, 2_000), (2_000, 1 << 16), (10**6, 1 << 30)):
        monkeypatch.setattr(bpe, "CACHE_WORDS", limit)
        monkeypatch.setattr(bpe, "BATCH_BYTES", size)
        for kind in ("index", "library"):
            bpe.encoder.cache_clear()
            assert list(bpe.encoder(kind).encode(data)) == want
    assert list(bpe.encoder("index").encode([])) == []
    bpe.encoder.cache_clear()


def test_new_words_are_merged_in_portions(monkeypatch):
    """The arrays of all new words of a batch at once took most of a worker's memory."""
    sizes = []
    whole = bpe.PairIndexEncoder.encode_words
    monkeypatch.setattr(bpe.PairIndexEncoder, "encode_words", lambda self, words: sizes.append(len(words)) or whole(self, words))
    monkeypatch.setattr(bpe, "WORDS_TOGETHER", 100)
    bpe.encoder.cache_clear()
    text = " ".join(["<|endoftext|>", *made_words(1_000)]).encode()
    assert list(bpe.encoder("index").encode([text])) == list(bpe.encoder("library").encode([text]))
    assert len(sizes) > 5 and max(sizes) <= 100
    bpe.encoder.cache_clear()
