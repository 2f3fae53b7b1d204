"""Options carried through every job (the reference reads these from YAML)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PackOptions:
    # Fixed defaults (values the results depend on).
    languages: tuple[str, ...] = ("typescript", "python", "javascript", "go")
    exclude: tuple[str, ...] = ("node_modules", ".git", "dist", "__pycache__", "*.min.js", ".next", "build")
    max_pack_tokens: int = 6000
    symbol_max_body_lines: int = 60
    max_call_sites: int = 5
    semantic_threshold: float = 0.40
    semantic_k: int = 8
    convention_k: int = 3
    blast_hops: int = 2
    pack_commits: int = 3
    default_commits: int = 5
    chunk_chars: int = 2000
    cache_ttl_seconds: int = 300
    debounce_seconds: float = 2.0
    # Matching switches for documented quirks (defaults follow the reference).
    word_boundaries: bool = False
    symbol_stop_words: tuple[str, ...] = ()   # Q2: e.g. ("Explain", "The"); none by default
    trim_file_dots: bool = False              # Q4: "src/a.py." -> "src/a.py"
    call_match: str = "exact"          # or "last_segment"
    file_match: str = "contains"       # or "suffix"
    # Sizing of distributed vector search blocks.
    knn_query_block_rows: int = 4096
    knn_chunk_block_rows: int = 65536
    counter: object = field(default=None, hash=False, compare=False)      # U3: a tokens.TokenCounter
    extra: dict = field(default_factory=dict, hash=False, compare=False)
