"""What operators keep in a Python worker, and how it goes."""

import public_tokenizers

from rasterloom.llm import _base, token_counts, token_files


def test_an_operator_drops_what_others_left():
    _base.claim_worker("token_files")
    first = token_files.encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    _base.claim_worker("token_files")
    assert token_files.encoder(public_tokenizers.path("byte_bpe_50k.json"), 2) is first
    _base.claim_worker("token_counts")
    token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert token_files.encoder.cache_info().currsize == 0 and token_counts.counter.cache_info().currsize == 1
    _base.claim_worker("similar")
    assert token_counts.counter.cache_info().currsize == 0
