"""Every tunable of the engine, with its default."""

from __future__ import annotations

from dataclasses import dataclass, field

from storyrank.functions.stopwords import BASE_STOP_WORDS, EXTRA_STOP_WORDS


@dataclass(frozen=True)
class CleanConfig:
    """`stem` and `lemmatise` each need their table; the whole job runs with `lemmatise`."""

    remove_stop: bool = True
    stem: bool = False
    lemmatise: bool = False
    min_word_length: int = 3
    stop_words: tuple[str, ...] = tuple(sorted({*BASE_STOP_WORDS, *EXTRA_STOP_WORDS}))


@dataclass(frozen=True)
class LookupConfig:
    """Rows up to which a look-up table is broadcast: a key and a number each, about 100 bytes."""

    max_broadcast_rows: int = 1_000_000

    @property
    def max_arrow_rows(self) -> int:
        """Rows that travel as Arrow columns, where a word and a number take about 25 bytes."""
        return 4 * self.max_broadcast_rows


@dataclass(frozen=True)
class TfIdfConfig:
    min_df: int = 5
    max_df: float = 0.5
    stop_words: tuple[str, ...] = tuple(BASE_STOP_WORDS)


@dataclass(frozen=True)
class LsaConfig:
    components: int = 100
    oversample: int = 10
    rounds: int = 5
    seed: int = 42
    # size of the block of the dense term basis (terms x width x 8 bytes) that is broadcast at a time
    max_block_bytes: int = 64 * 1024 * 1024


@dataclass(frozen=True)
class ClusterConfig:
    k: int = 25
    library_default_k: int = 8
    max_iter: int = 20
    # a round in which no centre moves farther is the last
    tol: float = 1e-4
    seed: int = 42


@dataclass(frozen=True)
class RankConfig:
    candidates: int = 30
    events: int = 2
    order: str = "farthest"
    tags: tuple[str, ...] = ("NN", "NNS", "NNP", "NNPS", "RB", "VB")
    default_tag: str = "NN"
    distance_digits: int = 3


@dataclass(frozen=True)
class TopicConfig:
    k: int = 25
    min_df: int = 4
    max_features: int = 500
    max_iter: int = 20
    words_per_topic: int = 10
    seed: int = 42


@dataclass(frozen=True)
class PhraseConfig:
    min_count: int = 4
    threshold: float = 2.0
    delimiter: str = "_"


@dataclass(frozen=True)
class WordVectorConfig:
    size: int = 50
    window: int = 7
    min_count: int = 4
    sample: float = 1e-4
    negatives: int = 5
    rounds: int = 5
    similar: int = 10
    seed: int = 42


@dataclass(frozen=True)
class PipelineConfig:
    clean: CleanConfig = field(default_factory=CleanConfig)
    lookup: LookupConfig = field(default_factory=LookupConfig)
    tfidf: TfIdfConfig = field(default_factory=TfIdfConfig)
    lsa: LsaConfig = field(default_factory=LsaConfig)
    cluster: ClusterConfig = field(default_factory=ClusterConfig)
    rank: RankConfig = field(default_factory=RankConfig)
