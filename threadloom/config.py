"""Settings of index building and navigation, validated when set."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, fields

_BOUNDS = {
    "smoothing_lambda": (0, 1), "max_steps": (1, None), "navigation_alpha": (0, None), "navigation_beta": (0, None), "navigation_gamma": (0, None),
    "navigation_delta": (0, None), "navigation_backtrack_penalty": (0, None), "navigation_novelty_bonus": (0, None), "navigation_prior_weight": (0, None),
    "neighbor_top_k": (1, None), "neighbor_min_cosine": (-1, 1), "clarify_similarity_threshold": (0, 1), "hierarchy_max_depth": (1, None),
    "min_cluster_size": (1, None), "transition_policy_mix_eta": (0, 1), "dag_tau": (0, 1), "topic_chunk_top_m": (1, None), "topic_chunk_min_prob": (0, 1),
    "topic_chunk_ancestor_decay": (0, 1), "n_coarse": (1, None), "n_fine": (1, None), "additive_alpha": (0, None), "exploration_factor": (0, 1), "rerank_weight_topic": (0, 1), "rerank_weight_cosine": (0, 1), "rerank_weight_bm25": (0, 1),
}


@dataclass(frozen=True)
class Settings:
    smoothing_lambda: float = 0.7
    max_steps: int = 32
    navigation_alpha: float = 0.5
    navigation_beta: float = 0.3
    navigation_gamma: float = 0.5
    navigation_delta: float = 0.5
    navigation_backtrack_penalty: float = 5.0
    navigation_novelty_bonus: float = 0.3
    navigation_prior_weight: float = 0.2
    navigation_temperature: float = 1.0
    navigation_greedy: bool = False
    index_storage_path: str | None = None
    neighbor_top_k: int = 20
    neighbor_min_cosine: float = 0.0
    clarify_similarity_threshold: float = 0.7
    hierarchy_max_depth: int = 3
    min_cluster_size: int = 2
    transition_policy_mix_eta: float = 1.0
    dag_tau: float | None = None
    topic_chunk_top_m: int = 2
    topic_chunk_min_prob: float = 0.15
    topic_chunk_ancestor_decay: float = 0.7
    rerank_weight_topic: float = 0.6
    rerank_weight_cosine: float = 0.4
    rerank_weight_bm25: float = 0.0
    n_coarse: int = 5
    n_fine: int = 3
    additive_alpha: float = 0.0
    exploration_factor: float = 0.0
    seed: int = 42

    def __post_init__(self):
        for name, (low, high) in _BOUNDS.items():
            value = getattr(self, name)
            if value is None and name == "dag_tau":
                continue
            if not isinstance(value, (int, float)) or value < low or (high is not None and value > high):
                raise ValueError(f"{name} must lie in [{low}, {'inf' if high is None else high}]; got {value!r}")
        if not self.navigation_temperature > 0:
            raise ValueError("navigation_temperature must be above 0")

    @classmethod
    def of(cls, **given) -> Settings:
        """From keywords; unknown names are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    @classmethod
    def debug_preset(cls) -> Settings:
        """Short greedy walks for a look at how navigation behaves."""
        return cls(
            max_steps=5, navigation_greedy=True, navigation_temperature=0.35, navigation_gamma=1.2, navigation_novelty_bonus=0.05, navigation_prior_weight=0.3,
            neighbor_top_k=6, neighbor_min_cosine=0.35, clarify_similarity_threshold=0.8, transition_policy_mix_eta=1.0, dag_tau=None,
        )

    def with_(self, **changed) -> Settings:
        """A copy with some values changed, validated again."""
        return dataclasses.replace(self, **changed)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)
