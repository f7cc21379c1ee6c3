"""Settings of the engine, with defaults, presets and checks."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace

from quillon.errors import InvalidConfig
from quillon.functions.vectors import Metric


def _check(good: bool, message: str) -> None:
    if not good:
        raise InvalidConfig(message)


@dataclass(frozen=True)
class CollectionConfig:
    """router_top_m is the number of segments that a search looks at; 0 is all of them. segment_target_size is kept with the
    settings, but nothing is left out of a merge for it."""

    name: str
    dimension: int
    metric: str = "cosine"
    staging_threshold: int = 10_000
    num_clusters: int = 100
    router_top_m: int = 0
    l0_max_segments: int = 10
    segment_target_size: int = 100_000

    def __post_init__(self) -> None:
        _check(bool(self.name) and "/" not in self.name and not self.name.startswith((".", "_")), f"bad collection name: {self.name!r}")
        _check(self.dimension > 0, "dimension must be positive")
        _check(self.staging_threshold > 0 and self.num_clusters > 0, "staging_threshold and num_clusters must be positive")
        _check(self.l0_max_segments > 1 and self.segment_target_size > 0 and self.router_top_m >= 0, "bad segment settings")
        object.__setattr__(self, "metric", Metric.parse(self.metric).value)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "CollectionConfig":
        return CollectionConfig(**json.loads(text))


@dataclass(frozen=True)
class KMeansConfig:
    num_clusters: int = 100
    max_iterations: int = 20
    tolerance: float = 0.001
    seed: int = 42


@dataclass(frozen=True)
class PqConfig:
    subvectors: int = 8
    centroids: int = 256
    max_iterations: int = 25
    tolerance: float = 0.001
    seed: int = 42
    opq_iterations: int = 10
    residual: bool = True
    refine_candidates: int = 100

    def validate(self, dimension: int) -> None:
        _check(self.subvectors > 0 and self.centroids > 0, "subvectors and centroids must be positive")
        _check(dimension % self.subvectors == 0, f"dimension {dimension} is no multiple of {self.subvectors} subvectors")
        _check(self.centroids <= 65536, "at most 65536 centroids")


@dataclass(frozen=True)
class HnswConfig:
    """A cluster below min_cluster_size has no graph, one above max_graph_size several, each of a part of it."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    seed: int = 42
    heuristic: bool = True
    min_cluster_size: int = 32
    max_graph_size: int = 100_000

    def __post_init__(self) -> None:
        _check(self.m > 0, "m must be positive")
        _check(self.ef_construction >= self.m, "ef_construction must be at least m")
        _check(self.ef_search > 0, "ef_search must be positive")

    @property
    def level_scale(self) -> float:
        return 1 / math.log(max(2, self.m))

    def most(self, layer: int) -> int:
        """Neighbours that a node may keep."""
        return 2 * self.m if layer == 0 else self.m


@dataclass(frozen=True)
class TextConfig:
    """stemming is a language's name, or None for none."""

    k1: float = 1.2
    b: float = 0.75
    max_token_bytes: int = 40
    stemming: str | None = "english"
    fields: tuple[str, ...] = ("text", "title", "tags")

    def __post_init__(self) -> None:
        _check(self.k1 >= 0, "k1 must not be negative")
        _check(0 <= self.b <= 1, "b must be between 0 and 1")
        _check(bool(self.fields), "a field at least must be indexed")


@dataclass(frozen=True)
class HybridConfig:
    """lambda_ is clamped to [0, 1]; the two filters are off while None."""

    method: str = "weighted"
    lambda_: float = 0.5
    rrf_k: int = 60
    temperature: float = 1.0
    candidates_per_source: int = 100
    min_text_score: float | None = None
    max_vector_distance: float | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "lambda_", min(1.0, max(0.0, self.lambda_)))
        _check(self.rrf_k >= 0 and self.temperature > 0 and self.candidates_per_source > 0, "bad fusion settings")


@dataclass(frozen=True)
class RefinementConfig:
    initial_nprobe: int = 5
    refinement_nprobe: int = 20
    initial_timeout_ms: int = 50
    max_timeout_ms: int = 200


@dataclass(frozen=True)
class EmbedConfig:
    model: str = "hashing"
    dimension: int = 512
    batch_size: int = 32
    normalize: bool = True
    chunk_size: int = 256
    chunk_overlap: int = 32

    def __post_init__(self) -> None:
        _check(self.dimension > 0 and self.batch_size > 0, "dimension and batch_size must be positive")
        _check(0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap must be below chunk_size")


@dataclass(frozen=True)
class QueryConfig:
    top_k: int = 10
    nprobe: int = 4
    include_payload: bool = False
    refinement: bool = False


@dataclass(frozen=True)
class EngineConfig:
    """All sections; a section that isn't wanted is None."""

    kmeans: KMeansConfig = field(default_factory=KMeansConfig)
    query: QueryConfig = field(default_factory=QueryConfig)
    pq: PqConfig | None = None
    hnsw: HnswConfig | None = None
    text: TextConfig | None = None
    hybrid: HybridConfig = field(default_factory=HybridConfig)
    refinement: RefinementConfig = field(default_factory=RefinementConfig)
    embed: EmbedConfig = field(default_factory=EmbedConfig)

    @staticmethod
    def high_recall() -> "EngineConfig":
        return EngineConfig(query=QueryConfig(nprobe=20, refinement=True))

    @staticmethod
    def low_latency() -> "EngineConfig":
        return EngineConfig(query=QueryConfig(nprobe=5), pq=PqConfig(), hnsw=HnswConfig())

    @staticmethod
    def with_text() -> "EngineConfig":
        return EngineConfig(text=TextConfig())

    def validate(self, dimension: int) -> None:
        if self.pq:
            self.pq.validate(dimension)
        _check(self.query.top_k > 0 and self.query.nprobe > 0, "top_k and nprobe must be positive")

    def with_(self, **sections) -> "EngineConfig":
        return replace(self, **sections)
