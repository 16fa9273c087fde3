"""Token counts: an estimate by bytes, or exact ones with a rank file that the caller names."""

from __future__ import annotations

import base64
from functools import lru_cache

from quillet.functions.sizes import CL100K_NAMES, O200K_NAMES, PRICES, PROFILES

try:  # exact counts need tiktoken
    import tiktoken
except ImportError:
    tiktoken = None

#: The usual split of text before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(rank_file: str):
    if tiktoken is None:
        raise RuntimeError("exact token counts need tiktoken")
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, rank_file: str | None = None) -> int:
    """A quarter of the bytes, rounded up, unless a rank file gives the exact count."""
    return len(_encoding(rank_file).encode_ordinary(text)) if rank_file else -(-len(text.encode()) // 4)


def token_savings_pct(json_text: str, table_text: str, rank_file: str | None = None) -> float:
    """May be negative; 0 if the JSON has no tokens."""
    n = count_tokens(json_text, rank_file)
    return (1 - count_tokens(table_text, rank_file) / n) * 100 if n else 0.0


def family(name: str) -> str:
    n = name.lower()
    if n in PROFILES:
        return PROFILES[n]
    return "o200k" if any(w in n for w in O200K_NAMES) else "cl100k" if any(w in n for w in CL100K_NAMES) else "heuristic"


def cost_usd(tokens: int, profile: str = "heuristic", kind: str = "input") -> float:
    return tokens / 1e6 * PRICES[family(profile)][kind]


def cost_savings_usd(json_tokens: int, table_tokens: int, profile: str = "heuristic", kind: str = "input") -> float:
    return cost_usd(max(0, json_tokens - table_tokens), profile, kind)
