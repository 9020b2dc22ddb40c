"""Token ids by public vocabularies."""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Behind the last byte of a word; a byte that no text for the fast way holds.
WORD_END = b"\x01"


@functools.cache
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """text -> ids for a byte-level .json (its twin .tiktoken gives the same ids several times faster) or .tiktoken file."""
    import tiktoken
    from tokenizers import Tokenizer

    special, ranks = {}, vocabulary
    if vocabulary.endswith(".json"):
        exact = Tokenizer.from_file(vocabulary)
        whole = lambda text: exact.encode(text, add_special_tokens=False).ids
        special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
        ranks = vocabulary[: -len("json")] + "tiktoken"
        try:
            open(ranks, "rb").close()
        except FileNotFoundError:
            return whole
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole(text)
        return fast.encode_ordinary(text)

    return encode


@functools.cache
def word_encoder(vocabulary: str) -> Callable[[pa.Array], list[np.ndarray]]:
    """texts -> the ids of each, for a .json vocabulary of word-end BPE that lower-cases and drops white space (null: none).

    Texts are cut at white space and only the different strings between are encoded, all at once: they are split into words, and a merge table
    with a mark behind each word's last byte, which no word holds, gives the same ids as the vocabulary's own merges. Texts with
    characters beyond Latin-1, with control characters or with a special token's name go whole through the tokenizer itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t.content for t in exact.get_added_tokens_decoder().values()}

    def raw(token: str) -> bytes:
        return bytes(byte_of[c] for c in token.removesuffix(end)) + (WORD_END if token.endswith(end) else b"")

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + WORD_END: 256 + b for b in range(256)}
    for pair in model["merges"]:
        ranks.setdefault(raw("".join(pair.split(" ") if isinstance(pair, str) else pair)), len(ranks))
    number = {raw(token): k for token, k in model["vocab"].items() if token not in special}
    ids_of = np.array([number.get(token, 0) for token in ranks], "<u4")
    fast = tiktoken.Encoding(vocabulary, pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
    gap = ranks[b"\x02" + WORD_END]
    letters, digits = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
    words = re.compile(rf"\x02|'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}\x02]+")
    odd = r"[^\x09-\x0d\x20-\x7e\x{a1}-\x{ff}]|" + "|".join(map(re.escape, sorted(special)))

    def encode(texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, odd)
        cut = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        found = cut.flatten().dictionary_encode()
        if not len(found):
            out = [np.zeros(0, "<u4")] * len(texts)
        else:
            strings = pa.ListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int32()), found.dictionary)
            joined = pc.binary_join(strings, "\x02")[0].as_py().lower()
            got = fast.encode_to_numpy("\x01".join([*words.findall(joined), ""]))
            ends = np.append(np.flatnonzero(got == gap), len(got))
            starts = np.append(0, ends[:-1] + 1)
            flat, place = ids_of[got], found.indices.to_numpy()
            n = (ends - starts)[place]
            stop = np.cumsum(n)
            flat = flat[np.repeat(starts[place] - (stop - n), n) + np.arange(stop[-1])]
            at = np.append(0, stop)[np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy()))]
            out = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[k] = np.array(exact.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, "<u4")
        return out

    return encode
