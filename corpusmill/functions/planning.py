"""Driver-side arithmetic: how many splits, shards and sequences."""

from __future__ import annotations

from dataclasses import dataclass

GB = 1 << 30


@dataclass(frozen=True)
class SplitCounts:
    train: int
    dev: int
    test: int

    @property
    def total(self) -> int:
        return self.train + self.dev + self.test


def default_training_splits(size_gb: float, given: int | None = None) -> int:
    """The given number, or one by input size."""
    if given is not None:
        return given
    for limit, count in ((10, 32), (100, 128)):
        if size_gb < limit:
            return count
    return 256


def split_counts(size_gb: float, train: int | None = None, dev: int | None = None, test: int | None = None, dev_ratio: float | None = None, test_ratio: float | None = None) -> SplitCounts:
    """Splits of each kind: from all three counts, or from ratios on top of the training splits."""
    counts, ratios = (dev, test), (dev_ratio, test_ratio)
    if any(c is not None for c in counts):
        if any(r is not None for r in ratios):
            raise ValueError("give dev and test splits either as counts or as ratios")
        if train is None or any(c is None for c in counts):
            raise ValueError("split counts have to be given for train, dev and test together")
        return SplitCounts(train, dev, test)
    dev_share, test_share = (r or 0.0 for r in ratios)
    if dev_share + test_share >= 1:
        raise ValueError("the ratios of dev and test leave nothing to train on")
    train = default_training_splits(size_gb, train)
    total = int(train / (1 - dev_share - test_share))
    held = int(total * test_share)
    return SplitCounts(train, total - train - held, held)


def shuffle_mode(size_bytes: int) -> str:
    return "on_RAM" if size_bytes < 2 * GB else "large_file"


def adjust_splits(splits: int, workers: int) -> int:
    """The least multiple of workers that isn't below splits."""
    if splits < 1 or workers < 1:
        raise ValueError("splits and workers must be positive")
    return -(-splits // workers) * workers


def sequence_length(model_config: dict) -> int:
    for key in ("max_position_embeddings", "n_positions"):
        if model_config.get(key) is not None:
            return model_config[key]
    raise ValueError("the model configuration names no sequence length")


def splits_for_one_batch(size_bytes: int, splits: int, workers: int, batch_size: int, accumulation: int, length: int) -> int:
    """splits, or twice the workers if the input is too small for a batch from each split; ValueError if that is too many still."""
    need = lambda n: n * accumulation * batch_size * length * 3
    for n in (splits, 2 * workers):
        if size_bytes >= need(n):
            return n
    raise ValueError(f"{size_bytes} bytes can't fill one batch of {batch_size} sequences of {length} tokens in {2 * workers} splits")


def row_targets(total: int, files: int) -> list[int]:
    """Rows of each file if they are to differ by one at most."""
    return [total // files + (i < total % files) for i in range(files)]
