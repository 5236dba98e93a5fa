"""Added tokens in texts: the ids of the tokenizers library as it comes, with add_special_tokens=False."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer as Oracle

from covergrid.llm import packing
from tests.llm.test_packing import AWKWARD, check

TEXTS = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|endoftext|>b", " <|endoftext|>  x", "<|endoftext| >", "<|ENDOFTEXT|>", "\n<|endoftext|>\n\n y "]


def test_added_tokens(spark):
    oracle = Oracle.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t = packing.Tokenizer(added=packing.added_tokens())
    assert np.frombuffer(t.ids(TEXTS[0]), "<u4").tolist() == [31373, 220, 50256, 995]
    for text in TEXTS + AWKWARD:
        assert np.frombuffer(t.ids(text), "<u4").tolist() == oracle.encode(text, add_special_tokens=False).ids, repr(text)
    texts = dict(enumerate([*TEXTS, "<|endoftext|> some words " * 900]))
    check(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts, oracle)
