"""spanloom: lexical retrieval and span analytics over chunk tables, on PySpark."""

from spanloom.config import ChunkConfig, PackingConfig, RankingConfig

__all__ = ["ChunkConfig", "PackingConfig", "RankingConfig"]
