"""Training and evaluation settings, as one frozen driver-side value."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class RouterConfig:
    num_clusters: int = 4
    utility_beta: float = 0.1
    lambda_soft: float = 0.5
    # None means "use lambda_soft"; an explicit value always wins.
    fusion_beta: float | None = None
    objective: str = "utility"  # utility | min_cost
    quality_threshold: float = 0.0
    cluster_tau: float | None = None
    coarse_clusters: int | None = None
    coarse_batch_size: int = 2048
    coarse_max_iter: int = 200
    cluster_fit_size: int = 2000  # summaries per bucket; every record is in one
    prob_temp: float = 1.0
    embedding_dim: int = 384
    hash_buckets: int = 128
    embed_k: int | None = None
    cost_weight: float = 0.5
    softmax_temperature: float = 0.5
    blend_costaware: float = 0.5
    fit_iterations: int = 50
    hidden_units: tuple[int, ...] | None = None  # None: a regression; (256, 128): two hidden layers
    enable_calibration: bool = True
    fallback_strategy: str = "best_fixed"  # best_fixed | cheapest | name
    fallback_model: str | None = None
    use_query_features: bool = True
    seed: int = 42

    def __post_init__(self) -> None:
        if self.objective not in ("utility", "min_cost"):
            raise ValueError(f"unknown objective {self.objective!r}")
        if self.embed_k is not None and self.embed_k <= 0:
            raise ValueError("embed_k must be positive or None")
        if self.hidden_units is not None:
            object.__setattr__(self, "hidden_units", tuple(self.hidden_units))  # a stored config holds a list

    @property
    def beta(self) -> float:
        """Branch weight, clipped to [0, 1]."""
        value = self.lambda_soft if self.fusion_beta is None else self.fusion_beta
        return max(0.0, min(1.0, float(value)))

    def coarse_count(self, n_rows: int) -> int:
        """Coarse cluster count, never above the number of rows."""
        k = max(1, self.num_clusters)
        wanted = self.coarse_clusters or max(4 * k, k + 4)
        return max(1, min(wanted, n_rows))

    @property
    def preparing(self) -> tuple:
        """The settings that decide features and embeddings; fits that agree in them can share the stored ones."""
        return self.use_query_features, self.hash_buckets, self.embedding_dim

    @property
    def clustering(self) -> tuple:
        """The settings that decide the clusters; fits that agree in them can share one."""
        return (
            self.num_clusters,
            self.coarse_clusters,
            self.coarse_batch_size,
            self.coarse_max_iter,
            self.cluster_tau,
            self.cluster_fit_size,
            self.embed_k,
            self.seed,
        )

    def as_dict(self) -> dict[str, object]:
        return asdict(self)
