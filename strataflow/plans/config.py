"""Settings of an index and of its searches, checked where they are made."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, fields, replace

INDEX_TYPES, METRICS = ("Flat", "IVF", "HNSW"), ("cosine", "l2")

# Public names of settings that have no effect here, as Spark does or doesn't need what they are about.
#   Models, their clients, caches, folders, devices and threads belong to the session and to the functions that are passed in.
OTHERS = ("llm_api_key", "llm_base_url", "llm_model_name", "embed_model_source", "embed_len", "batch_size", "unstructured_strategy", "storage", "cache", "data", "mode_dir", "use_gpu", "threads")


@dataclass(frozen=True)
class Config:
    """Names and defaults are fixed values, as blueprints have them."""

    # what chunks are made of
    proc_chunk_token_size: int = 256
    proc_enable_raptor: bool = False
    proc_raptor_max_clusters: int = 10
    use_code_space: bool = True
    # what stands for a chunk
    embed_model: str = "hash"
    embed_dim: int = 64
    # how rows are found
    index_type: str = "HNSW"
    metric: str = "cosine"
    ivf_nlist: int = 100
    ivf_nprobe: int = 10
    hnsw_m: int = 64
    hnsw_ef_con: int = 200
    hnsw_ef: int = 128
    # how they are ranked
    vec_weight: float = 0.8
    kw_weight: float = 0.2
    top_k: int = 5
    threshold: float = 0.6
    mode_name: str = "default"

    def __post_init__(self) -> None:
        if abs(self.vec_weight + self.kw_weight - 1) > 1e-6 or not 0 <= self.vec_weight <= 1:
            raise ValueError("the weights must be between 0 and 1 and sum to 1")
        if self.index_type not in INDEX_TYPES or self.metric not in METRICS:
            raise ValueError(f"index_type is one of {INDEX_TYPES}, metric of {METRICS}")
        if min(self.top_k, self.proc_chunk_token_size, self.embed_dim, self.ivf_nlist, self.ivf_nprobe, self.hnsw_m, self.hnsw_ef_con, self.hnsw_ef, self.proc_raptor_max_clusters) < 1:
            raise ValueError("counts and sizes must be positive")

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """A blueprint. Settings without effect here are left out, and so are unknown names, which give a warning."""
        given = json.loads(text)
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(given) - known - set(OTHERS)):
            warnings.warn(f"unknown settings: {', '.join(unknown)}", stacklevel=2)
        return cls(**{k: v for k, v in given.items() if k in known})

    def index_params(self) -> dict[str, int]:
        """What the index type takes."""
        by_type = {"IVF": {"nlist": self.ivf_nlist, "nprobe": self.ivf_nprobe}, "HNSW": {"M": self.hnsw_m, "efConstruction": self.hnsw_ef_con, "efSearch": self.hnsw_ef}}
        return by_type.get(self.index_type, {})

    def summary(self) -> str:
        return "\n".join(f"{f.name}: {getattr(self, f.name)}" for f in fields(self))

    def updated(self, **changes) -> Config:
        return replace(self, **changes)


def rebuild_names(config: Config) -> tuple[str, ...]:
    """The settings whose change asks for a new index; others apply at once."""
    cells = {"IVF": ("ivf_nlist",), "HNSW": ("hnsw_m", "hnsw_ef_con")}.get(config.index_type, ())
    trees = ("proc_raptor_max_clusters",) if config.proc_enable_raptor else ()
    return ("index_type", "embed_model", "embed_dim", "proc_chunk_token_size", "proc_enable_raptor", "use_code_space", *cells, *trees)


def update_plan(loaded: Config | None, new: Config) -> str:
    """``rebuild`` or ``hot``. Both metrics rank unit vectors alike, so that a change of metric applies at once."""
    if loaded is None or any(getattr(loaded, f) != getattr(new, f) for f in rebuild_names(new)):
        return "rebuild"
    return "hot"
