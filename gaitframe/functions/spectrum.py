"""Power-spectrum features of window channels (Arrow batches through numpy)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitframe.schema import TARGET_HZ

# Names, in order, and the band limits in Hz.
SPECTRAL = ["dom_freq", "dom_energy", "spec_entropy", "spec_centroid",
            "band_low", "band_mid", "band_high"]
BANDS = [(0.0, 2.0), (2.0, 5.0), (5.0, 25.0)]
EPS = 1e-12
#: Windows that are transformed at a time, whatever the size of the batches.
BLOCK = 256


def spectrum(signals: np.ndarray, rate_hz: float = TARGET_HZ) -> np.ndarray:
    """(..., n) real signals to (..., 7) features."""
    power = np.abs(np.fft.rfft(signals - signals.mean(axis=-1, keepdims=True))) ** 2
    freq = np.fft.rfftfreq(signals.shape[-1], 1.0 / rate_hz)
    share = power / (power.sum(axis=-1, keepdims=True) + EPS)
    top = power[..., 1:].argmax(axis=-1) + 1
    columns = [
        freq[top],
        np.take_along_axis(share, top[..., None], axis=-1)[..., 0],
        -(share * np.log(share + EPS)).sum(axis=-1) / np.log(len(freq)),
        (share * freq).sum(axis=-1),
    ]
    columns += [share[..., (freq >= lo) & (freq < hi)].sum(axis=-1) for lo, hi in BANDS]
    return np.stack(columns, axis=-1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def spectrum_udf(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for channels in batches:
        made = [pa.array([], pa.list_(pa.float64()))]
        for i in range(0, len(channels[0]), BLOCK):
            part = [c.slice(i, BLOCK) for c in channels]
            size, out = part[0].value_lengths().to_numpy(zero_copy_only=False), np.empty((len(part[0]), len(part) * len(SPECTRAL)))
            start, flat = np.cumsum(size) - size, np.stack([c.flatten().to_numpy(zero_copy_only=False) for c in part])
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                block = np.ascontiguousarray(flat[:, start[rows][:, None] + np.arange(n)].transpose(1, 0, 2))
                out[rows] = spectrum(block).reshape(len(rows), -1)
            made.append(pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], out.ravel()))
        yield pa.concat_arrays(made)
