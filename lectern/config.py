"""Sizes, weights and switches of the engine, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    # chunking
    chars_per_token: int = 4
    chunk_tokens: int = 800
    overlap_words: int = 100
    child_tokens: int = 200
    parent_tokens: int = 1500
    min_chunk_chars: int = 150
    # retrieval
    top_k: int = 5
    overfetch: int = 8
    weight_vector: float = 0.3
    weight_keywords: float = 0.5
    bonus_name: float = 0.4
    embedding_dim: int = 64
    embedding_batch: int = 8
    embedding_attempts: int = 3
    # how many pieces files and documents are dealt over before they are parsed; None: those of the scan
    input_partitions: int | None = None
    # files whose bytes one job reads, and new files that one batch of the stream takes
    files_at_once: int = 10_000
    # language
    language_chars: int = 500
    # graph
    triple_min_chars: int = 100
    triple_max_chars: int | None = 4000
    section_scan_chars: int = 500
    graph_section_min_chars: int = 80
    graph_hops: int = 2
    graph_edges: int = 30
    # pages sent to the table model, its replies and headings in labels; None: everything
    table_page_chars: int | None = 8000
    table_reply_chars: int | None = 8000
    label_chars: int | None = 40
    # what a judge model reads; None: everything
    judge_context_chars: int | None = 3000
    judge_snippet_chars: int | None = 300
    # SQL tool, conversation
    sql_rows: int = 50
    memory_turns: int = 10
    memory_chars: int = 1500
    # lexicons for re-ranking; empty means "no stop words, no bilingual expansion"
    stop_words: tuple[str, ...] = ()
    bilingual: dict[str, str] = field(default_factory=dict)
    # False reproduces the published results; True applies the documented corrections
    strict_units: bool = False
    whole_word_rejects: bool = False
    strip_page_headings: bool = False

    @property
    def chunk_chars(self) -> int:
        return self.chunk_tokens * self.chars_per_token

    @property
    def child_chars(self) -> int:
        return self.child_tokens * self.chars_per_token

    @property
    def parent_chars(self) -> int:
        return self.parent_tokens * self.chars_per_token


DEFAULT = EngineConfig()
