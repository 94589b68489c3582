"""Parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds and constants that results depend on.


@dataclass(frozen=True)
class CleanConfig:
    min_chars: int = 50
    max_chars: int = 50_000
    stub_chars: int = 200
    heading_chars: int = 30
    rounds: int = 8
    drop_rate_alarm: float = 0.15
    #: Convert variants of characters by a dictionary; enabling it without one is an error.
    convert: bool = False


@dataclass(frozen=True)
class ChunkConfig:
    min_chars: int = 450
    max_chars: int = 550
    overlap: int = 50
    overlap_max: int = 100
    hard_cut: int = 500
    tail_merge: int = 100
    merge_limit: int = 650
    id_prefix: str = "wiki"


@dataclass(frozen=True)
class EmbedConfig:
    model: str = "bge-m3"
    dim: int = 1024
    batch: int = 64
    timeout_s: int = 300
    retries: int = 3
    sleep_s: float = 2.0
    norm_floor: float = 1e-12


@dataclass(frozen=True)
class SearchConfig:
    recall_k: int = 50
    top_m: int = 5
    source_chars: int = 800


SYSTEM_PROMPT = "你是一个基于参考资料回答问题的助手。仅根据参考资料回答,引用时标注 [来源N];资料不足以回答时明确说明。"
EVAL_SET_SIZE, HIT_AT, WORST = 60, (5, 10), 10
