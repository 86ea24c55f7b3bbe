"""BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from brute_llm import docs_frame
from drawlake.llm.bpe import Encoder, Tokenizer as SparkTokenizer, load_vocabulary
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(9)
    fixed = ["", "a", "a" * 3000, " \n\n  x\t\ty ", "<|endoftext|>a<|endoftext|><|endoftext|> b", "I'm we'll it'sx ''s 's 12345 ½²³"]
    fixed += ["".join(pick.choice("ab ' .,lsve123\n\té日🎉") for _ in range(pick.randrange(60))) for _ in range(400)]
    fixed += [
        "".join(chr(pick.choice([pick.randrange(32, 0x250), pick.randrange(0x250, 0xD800), pick.randrange(0xE000, 0x20000)])) for _ in range(40))
        for _ in range(200)
    ]
    return fixed


def test_operator_equals_library(spark, library, texts):
    rows = [*enumerate(texts), (-1, None)]
    tokenizer = SparkTokenizer(spark, PATH)
    got = tokenizer.decode(tokenizer.encode(docs_frame(spark, rows))).collect()
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.ids for r in got} == want
    assert {r.doc_id: r.decoded for r in got} == {i: library.decode(x, skip_special_tokens=False) for i, x in want.items()}


def test_any_ids_decode(spark, library):
    pick = random.Random(5)
    rows = [(k, [pick.randrange(50300) for _ in range(pick.randrange(30))]) for k in range(200)] + [(900, None), (901, [-4, 10**6])]
    got = SparkTokenizer(spark, PATH).decode(spark.createDataFrame(rows, "k long, ids array<int>")).collect()
    want = {k: library.decode([i for i in ids or [] if 0 <= i < 50257], skip_special_tokens=False) for k, ids in rows}
    assert {r.k: r.decoded for r in got} == want


def test_each_token_is_its_own_encoding():
    vocabulary = load_vocabulary(PATH)
    encoder = Encoder(vocabulary)
    encoder.learn(list(vocabulary["ids"]))
    assert all(np.frombuffer(encoder.known[t], np.int32).tolist() == [i] for t, i in vocabulary["ids"].items())


def test_empty_table(spark):
    tokenizer = SparkTokenizer(spark, PATH)
    assert tokenizer.decode(tokenizer.encode(docs_frame(spark, []))).collect() == []


def test_long_texts_are_cut_at_words(library, monkeypatch):
    from drawlake.llm import bpe

    monkeypatch.setattr(bpe, "CHUNK", 50)
    pick = random.Random(4)
    text = "".join(pick.choice(["word", " it's", "  two", " \n", " 12", " é日", "'s 's", " ", "\t x", ". ", " ½", "\xa0y", "\x1c z"]) for _ in range(3000))
    parts = bpe.chunks(text, 50)
    assert len(parts) > 100 and "".join(parts) == text
    ids, ends = Encoder(load_vocabulary(PATH)).encode([text, "", text[:70], "x" * 500])
    want = [library.encode(t, add_special_tokens=False).ids for t in (text, "", text[:70], "x" * 500)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


LONG = """
import random, resource, sys
import numpy as np
import pyarrow as pa
from drawlake.llm import bpe
pick = random.Random(1)
words = ["".join(pick.choice("abcdefghijé") for _ in range(pick.randrange(3, 12))) for _ in range(400_000)]
encoder = bpe.Encoder(bpe.load_vocabulary(sys.argv[1]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = " ".join(pick.choice(words) for _ in range(int(sys.argv[2])))
ids, ends = encoder.encode([text])
size = len(text.encode())
assert sum(encoder.lengths[i] for i in ids.tolist()) == size
print(size >> 20, encoder.known_bytes >> 20, len(encoder.fits), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before >> 10)
"""


def test_memory_of_a_text_of_50_megabytes():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run(
        [sys.executable, "-c", LONG, PATH, str(6_000_000)], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}
    )
    assert done.returncode == 0, done.stderr
    size, known, fits, peak = map(int, done.stdout.split())
    assert size >= 45 and known <= 64 and fits <= 700_000 and peak < 1000, done.stdout
