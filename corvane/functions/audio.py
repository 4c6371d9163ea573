"""Audio kernels in numpy, run by Arrow batches: decoding, level and silence features, trimming, resampling.

A row whose bytes are no PCM wave keeps its place with `error` set and the features null.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

# The feature names.
FEATURES = (
    "duration_s", "rms_db", "peak_db", "crest_db", "dc_offset", "zcr", "frac_exact_zero", "lead_silence_s", "trail_silence_s", "noise_floor_db",
    "dyn_range_db", "hf_ratio_7k", "band_7k_8k_ratio", "rolloff_95_hz", "spectral_flatness", "clip_frac",
)
RATE = 16_000


def decode(raw: bytes) -> tuple[np.ndarray, int, int, int]:
    """(mono samples in -1..1, sample rate, channels, bytes a sample)."""
    with wave.open(io.BytesIO(raw)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        data = f.readframes(f.getnframes())
    if width == 2:
        x = np.frombuffer(data, "<i2") / 32768.0
    elif width == 1:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    else:
        raise ValueError(f"samples of {width} bytes")
    return x.reshape(-1, channels).mean(1), rate, channels, width


def encode(x: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setparams((1, 2, rate, 0, "NONE", ""))
        f.writeframes((np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Band-limited resampling by cutting or filling the spectrum."""
    if rate == to or not len(x):
        return x
    n = max(1, round(len(x) * to / rate))
    spectrum, kept = np.fft.rfft(x), np.zeros(n // 2 + 1, dtype=complex)
    m = min(len(kept), len(spectrum))
    kept[:m] = spectrum[:m]
    return np.fft.irfft(kept, n) * n / len(x)


def resample_polyphase(x: np.ndarray, rate: int, to: int = RATE, width: int = 10, beta: float = 5.0) -> np.ndarray:
    """Resampling by a windowed sinc, summed only where the output has a sample; the ratio's denominator is at most 1000.

    `width` is how many zeros of the sinc lie on each side, `beta` the shape of the Kaiser window.
    """
    ratio = Fraction(to, rate).limit_denominator(1000)
    up, down = ratio.numerator, ratio.denominator
    if up == down or not len(x):
        return x
    # times are counted in steps of an input sample / up
    wide = max(up, down)
    half = width * wide
    far = np.arange(-half, half + 1)
    table = np.sinc(far / wide) * np.kaiser(len(far), beta)
    table *= up / table.sum()
    taps = np.arange(2 * half // up + 1)
    out = np.empty(-(-len(x) * up // down))
    for low in range(0, len(out), 1 << 14):
        at = np.arange(low, min(len(out), low + (1 << 14)))[:, None] * down
        k = -((half - at) // up) + taps
        known = (k >= 0) & (k < len(x)) & (np.abs(at - k * up) <= half)
        out[low : low + len(at)] = np.where(known, x[np.clip(k, 0, len(x) - 1)] * table[np.clip(at - k * up + half, 0, 2 * half)], 0.0).sum(1)
    return out


def frame_rms(x: np.ndarray, size: int = 400, hop: int = 160) -> np.ndarray:
    if len(x) < size:
        return np.sqrt(np.mean(x * x, keepdims=True)) if len(x) else np.zeros(1)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.sqrt((frames * frames).mean(1))


def trim(x: np.ndarray, rate: int = RATE, below_db: float = 40.0, margin_s: float = 0.05) -> np.ndarray:
    """x from the first to the last frame within `below_db` of the loudest, with a margin; silence stays as it is."""
    level = frame_rms(x)
    loud = np.flatnonzero(level >= level.max() * 10 ** (-below_db / 20))
    if not len(loud) or level.max() == 0:
        return x
    margin = int(margin_s * rate)
    return x[max(0, loud[0] * 160 - margin) : min(len(x), loud[-1] * 160 + 400 + margin)]


def peak_normalise(x: np.ndarray, to: float = 0.95) -> tuple[np.ndarray, float]:
    """(x at the peak, gain in dB); silence gets gain 0."""
    peak = np.abs(x).max(initial=0.0)
    return (x, 0.0) if peak == 0 else (x * (to / peak), float(20 * np.log10(to / peak)))


def _db(v: float) -> float:
    return float(20 * np.log10(max(v, 1e-10)))


def describe(x: np.ndarray, rate: int) -> dict[str, float]:
    """The features of at least 400 samples. Silence at the ends is exact zeros; the noise floor is the level of the 10th percentile of frames."""
    if len(x) < 400:
        raise ValueError("fewer than 400 samples")
    rms, peak = float(np.sqrt(np.mean(x * x))), float(np.abs(x).max())
    sound = np.flatnonzero(x != 0)
    low, high = (_db(v) for v in np.percentile(frame_rms(x), [10, 95]))
    size = min(1024, len(x))
    segments = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(1, size // 2)]
    power = (np.abs(np.fft.rfft((segments - segments.mean(1, keepdims=True)) * np.hanning(size), axis=1)) ** 2).mean(0) + 1e-20
    hz = np.fft.rfftfreq(size, 1 / rate)
    total = power.sum()
    values = (
        len(x) / rate, _db(rms), _db(peak), _db(peak) - _db(rms), float(x.mean()), float(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1]))) if len(x) > 1 else 0.0,
        float(np.mean(x == 0)), (sound[0] if len(sound) else len(x)) / rate, (len(x) - 1 - sound[-1] if len(sound) else len(x)) / rate, low, high - low,
        float(power[hz >= 7000].sum() / total), float(power[(hz >= 7000) & (hz < 8000)].sum() / total), float(hz[np.searchsorted(np.cumsum(power), 0.95 * total)]),
        float(np.exp(np.log(power).mean()) / power.mean()), float(np.mean(np.abs(x) >= 0.999)),
    )
    return dict(zip(FEATURES, map(float, values)))


def mfcc_mean(x: np.ndarray, rate: int = RATE) -> list[float] | None:
    """Mean cepstrum, coefficients 1 to 19 of 26 mel bands; None for less than a quarter second or ten frames."""
    if len(x) < rate // 4 or len(x) < 512 + 9 * 160:
        return None
    frames = np.lib.stride_tricks.sliding_window_view(x, 512)[::160] * np.hamming(512)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 / 512
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), 28)
    edges = np.floor(513 * 700 * (10 ** (mel / 2595) - 1) / rate).astype(int)
    bank = np.zeros((26, power.shape[1]))
    for k in range(26):
        a, b, c = edges[k : k + 3]
        bank[k, a:b] = (np.arange(a, b) - a) / max(1, b - a)
        bank[k, b:c] = (c - np.arange(b, c)) / max(1, c - b)
    logs = np.log(power @ bank.T + 1e-10)
    basis = np.cos(np.pi * np.outer(np.arange(1, 20), np.arange(26) + 0.5) / 26)
    return (logs @ basis.T).mean(0).tolist()


def headers(frame: DataFrame, content: str = "content") -> DataFrame:
    """Other columns, with `duration_sec` (3 places), `sample_rate`, `channels`, `valid` (all of them above 0) and `error`, from the files' headers."""
    fields = [f for f in frame.schema.fields if f.name != content]
    schema = frame.drop(content).schema
    added = {"duration_sec": ("double", pa.float64()), "sample_rate": ("integer", pa.int32()), "channels": ("integer", pa.int32()), "valid": ("boolean", pa.bool_()), "error": ("string", pa.string())}
    for n, (kind, _) in added.items():
        schema = schema.add(n, kind)

    def one(raw: bytes | None) -> dict:
        try:
            with wave.open(io.BytesIO(raw or b"")) as f:
                n, rate, channels = f.getnframes(), f.getframerate(), f.getnchannels()
            return {"duration_sec": round(n / rate, 3), "sample_rate": rate, "channels": channels, "valid": n > 0 and rate > 0 and channels > 0}
        except Exception as bad:  # noqa: BLE001  errors are data here
            return {"valid": False, "error": f"{type(bad).__name__}: {bad}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column(content).to_pylist()]
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in fields} | {n: pa.array([r.get(n) for r in rows], k) for n, (_, k) in added.items()})

    return frame.mapInArrow(run, schema)


def features(frame: DataFrame, content: str = "content") -> DataFrame:
    """Other columns, the features, `native_sr`, `channels`, `sample_bytes`, `mfcc` and `error`; filter rows before this."""
    fields = [f for f in frame.schema.fields if f.name != content]
    ddl = ", ".join(f"{n} double" for n in FEATURES) + ", native_sr int, channels int, sample_bytes int, mfcc array<double>, error string"
    schema = frame.drop(content).schema
    for f in frame.sparkSession.createDataFrame([], ddl).schema.fields:
        schema = schema.add(f)
    arrow = dict.fromkeys(FEATURES, pa.float64()) | {"native_sr": pa.int32(), "channels": pa.int32(), "sample_bytes": pa.int32(), "mfcc": pa.list_(pa.float64()), "error": pa.string()}

    def one(raw: bytes | None) -> dict:
        try:
            x, rate, channels, width = decode(raw or b"")
            if not len(x):
                raise ValueError("no samples")
            x16 = resample_polyphase(x, rate)
            return describe(x16, RATE) | {"native_sr": rate, "channels": channels, "sample_bytes": width, "mfcc": mfcc_mean(x16)}
        except Exception as bad:  # noqa: BLE001  errors are data here
            return {"error": f"{type(bad).__name__}: {bad}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column(content).to_pylist()]
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in fields} | {n: pa.array([r.get(n) for r in rows], k) for n, k in arrow.items()})

    return frame.mapInArrow(run, schema)


def normalise(frame: DataFrame, content: str = "content") -> DataFrame:
    """Decode, mono, 16 kHz, trim, peak, 16-bit PCM: other columns with `content`, `gain_db`, lengths, levels and `error`."""
    fields = [f for f in frame.schema.fields if f.name != content]
    schema = frame.drop(content).schema
    added = {"content": ("binary", pa.binary()), "in_samples": ("long", pa.int64()), "out_samples": ("long", pa.int64()), "in_rms_db": ("double", pa.float64()), "out_rms_db": ("double", pa.float64()), "gain_db": ("double", pa.float64()), "error": ("string", pa.string())}
    for n, (kind, _) in added.items():
        schema = schema.add(n, kind)

    def one(raw: bytes | None) -> dict:
        try:
            x, rate, _, _ = decode(raw or b"")
            y, gain = peak_normalise(trim(resample(x, rate)))
            level = lambda v: _db(float(np.sqrt(np.mean(v * v))) if len(v) else 0.0)
            return {"content": encode(y), "in_samples": len(x), "out_samples": len(y), "in_rms_db": level(x), "out_rms_db": level(y), "gain_db": gain}
        except Exception as bad:  # noqa: BLE001
            return {"error": f"{type(bad).__name__}: {bad}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column(content).to_pylist()]
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in fields} | {n: pa.array([r.get(n) for r in rows], k) for n, (_, k) in added.items()})

    return frame.mapInArrow(run, schema)


def cached_features(frame: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of `frame` but the bytes, with the features of their file; those that a table in `folder` lacks are made and added to it.

    A file is known by its path, so a run that was cut short goes on where it stopped.
    """
    spark, files = frame.sparkSession, frame.select(path, content).dropDuplicates([path])
    try:
        files = files.join(spark.read.parquet(folder).select(path), path, "left_anti")
    except AnalysisException:  # no table yet
        pass
    features(files, content).write.mode("append").parquet(folder)
    return frame.drop(content).join(spark.read.parquet(folder), path, "left")


#: Steps of `transform` by name: functions of samples at RATE that return samples.
TRANSFORMS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"trim": trim, "peak": lambda x: peak_normalise(x)[0]}


def register(name: str):
    """Make a function of samples a step of `transform`."""

    def put(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        TRANSFORMS[name] = f
        return f

    return put


def transform(frame: DataFrame, names: list[str], content: str = "content") -> DataFrame:
    """Other columns, with the bytes after the named steps, one after another, and `error`; an unknown name is an error at once."""
    if unknown := [n for n in names if n not in TRANSFORMS]:
        raise ValueError(f"unknown transforms: {', '.join(unknown)}; there are {', '.join(sorted(TRANSFORMS))}")
    chain = [TRANSFORMS[n] for n in names]
    fields = [f for f in frame.schema.fields if f.name != content]

    def one(raw: bytes | None) -> tuple[bytes | None, str | None]:
        try:
            x, rate, _, _ = decode(raw or b"")
            x = resample_polyphase(x, rate)
            for step in chain:
                x = step(x)
            return encode(x), None
        except Exception as bad:  # noqa: BLE001
            return None, f"{type(bad).__name__}: {bad}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column(content).to_pylist()]
            done = {content: pa.array([r[0] for r in rows], pa.binary()), "error": pa.array([r[1] for r in rows], pa.string())}
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in fields} | done)

    return frame.mapInArrow(run, frame.drop(content).schema.add(content, "binary").add("error", "string"))


def tones(frame: DataFrame, hz: str, seconds: str) -> DataFrame:
    """Add `content`, a wave file of a tone with a lead of silence: synthetic input for tests and demos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for f, s in zip(batch.column(hz).to_pylist(), batch.column(seconds).to_pylist()):
                n = int(RATE * s)
                made.append(encode(np.concatenate([np.zeros(n // 4), 0.5 * np.sin(2 * np.pi * f * np.arange(n) / RATE)])))
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | {"content": pa.array(made, pa.binary())})

    return frame.mapInArrow(run, frame.withColumn("content", F.lit(b"")).schema)
