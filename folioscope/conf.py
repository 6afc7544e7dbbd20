"""Engine settings."""
from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Names and defaults of the settings that a deployment may set in its environment.
TRUE_WORDS = {"1", "true", "t", "yes", "y", "on"}


@dataclass(frozen=True)
class EngineConf:
    """All knobs of the engine; ``from_env`` reads upper-case variables of the same names."""

    parser_backend: str = "docling"
    parser_strict_page_match: bool = True
    chunker_version: str = "v2"
    vector_backend: str = "faiss"
    top_k: int = 8
    retrieval_mode: str = "hybrid"
    retrieval_query_fusion: bool = True
    retrieval_rrf_k0: int = 60
    retrieval_candidate_multiplier: int = 4
    retrieval_enable_rerank: bool = True
    retrieval_rerank_pool: int = 40
    ask_max_context_chunks: int = 6
    ask_max_context_chars: int = 12000
    ask_min_evidence_hits: int = 2
    ask_require_citations: bool = True
    ask_include_neighbor_chunks: bool = True
    ask_neighbor_window: int = 1
    ask_show_evidence_default: bool = False
    ask_json_default: bool = False
    llm_backend: str = "ollama"
    llm_model: str = "qwen3:8B"
    llm_base_url: str = "http://localhost:11434"
    llm_timeout_s: int = 120
    llm_temperature: float = 0.0
    agent_max_steps: int = 8
    agent_max_tool_calls: int = 3
    agent_max_retrieval_rounds: int = 2
    agent_min_evidence_hits: int = 2

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConf:
        """Settings with the values that ``env`` (by default the process environment) gives; blank ones keep the default."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = (env.get(f.name.upper()) or "").strip()
            if f.name == "agent_min_evidence_hits" and not raw:
                raw = (env.get("ASK_MIN_EVIDENCE_HITS") or "").strip()
            if raw:
                kind = type(f.default)
                given[f.name] = raw.lower() in TRUE_WORDS if kind is bool else kind(raw)
        return cls(**given)

    def problems(self) -> list[str]:
        """What is wrong with the settings, one message each."""
        allowed = {
            "parser_backend": {"docling", "llamaparse"},
            "chunker_version": {"v1", "v2"},
            "vector_backend": {"faiss", "bm25"},
            "retrieval_mode": {"base", "hybrid"},
            "llm_backend": {"gemini", "ollama"},
        }
        positive = (
            "top_k", "retrieval_rrf_k0", "retrieval_candidate_multiplier", "retrieval_rerank_pool", "ask_max_context_chunks",
            "ask_max_context_chars", "llm_timeout_s", "agent_max_steps", "agent_max_tool_calls", "agent_max_retrieval_rounds",
        )
        natural = ("ask_min_evidence_hits", "ask_neighbor_window", "agent_min_evidence_hits")
        found = [f"{n} must be one of {sorted(v)}, not {getattr(self, n)!r}" for n, v in allowed.items() if getattr(self, n) not in v]
        found += [f"{n} must be positive" for n in positive if getattr(self, n) <= 0]
        return found + [f"{n} must not be negative" for n in natural if getattr(self, n) < 0]

    def checked(self) -> EngineConf:
        """Itself, or a ValueError that lists all problems."""
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


def parse_ks(raw: str) -> list[int]:
    """The distinct positive cut-offs of a comma-separated list, ascending."""
    parts = [p.strip() for p in (raw or "").split(",") if p.strip()]
    if not parts or any(not p.lstrip("-").isdigit() or int(p) <= 0 for p in parts):
        raise ValueError(f"not a list of positive cut-offs: {raw!r}")
    return sorted({int(p) for p in parts})
