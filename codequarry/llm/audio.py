"""Audio columns: 8-bit PCM in RIFF containers, and features of what is read back from them.

Features: polyphase resampling, overlapped log-mel filterbanks in windows of one fixed shape, stored as an Arrow stream
of fixed-shape tensors with each window's time span, and speech-like segments from energy with hysteresis.

Defined results: a null payload is an empty one; payloads of any length are processed in blocks, so memory doesn't grow
with them beyond the payload; equal payloads have equal features; a payload too short for one frame has one frame, padded with
silence; repeated rows and empty tables are no special case; columns other than the id and the payload aren't read.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import rebatch, tidy

RATE, TARGET = 16_000, 8_000
FRAME, HOP, FFT, MELS = 200, 80, 256, 40
WINDOW = 64
#: Segments start above OPEN and end below CLOSE, in decibels of a frame's mean square; shorter ones than SHORTEST frames go.
OPEN, CLOSE, SHORTEST = -12.0, -18.0, 3
#: Frames computed at once.
BLOCK = 4096
PAD, UNIT = 255, 576


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples."""
    even = payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(even), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + even


def samples(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a RIFF file as `wav` writes it, or with other chunks in between."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@functools.lru_cache(maxsize=8)
def phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed-sinc low-pass filter for up/down, one row of taps per phase."""
    n = 2 * half * max(up, down) + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(up, down)) * np.hamming(n) / max(up, down) * up
    taps = -(-n // up)
    return np.concatenate([h, np.zeros(taps * up - n)]).reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, up: int, down: int, half: int = 8) -> np.ndarray:
    """x at up/down times its rate: each output sample is one phase's taps on neighbouring inputs."""
    bank = phases(up, down, half)
    taps = bank.shape[1]
    shift = half * max(up, down)  # the filter's delay, at the rate in between
    n = -(-len(x) * up // down)
    at = np.arange(n, dtype=np.int64) * down + shift
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(shift // up + taps + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    if up == 1:
        return windows[shift : shift + n * down : down][:n] @ bank[0]
    out = np.empty(n, np.float32)
    for p in range(up):
        mine = np.flatnonzero(at % up == p)
        for k in range(0, len(mine), BLOCK * HOP):
            some = mine[k : k + BLOCK * HOP]
            out[some] = windows[at[some] // up] @ bank[p]
    return out


@functools.lru_cache(maxsize=4)
def mel_bank(rate: int = TARGET, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangles at equal distances on the mel scale: a column per filter."""
    hz = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    up = (f[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    fall = (hz[2:] - f[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values (float16, a row per frame) and each frame's energy in decibels."""
    n = max(1, 1 + -(-max(0, len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)]) if len(x) < (n - 1) * HOP + FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    shape = np.hanning(FRAME).astype(np.float32)
    mel, energy = np.empty((n, MELS), np.float16), np.empty(n, np.float32)
    for k in range(0, n, BLOCK):
        f = frames[k : k + BLOCK]
        energy[k : k + BLOCK] = 10 * np.log10(np.einsum("ij,ij->i", f, f) / FRAME + 1e-10)
        power = np.abs(np.fft.rfft(f * shape, FFT)).astype(np.float32) ** 2
        mel[k : k + BLOCK] = np.log(power @ mel_bank() + 1e-6)
    return mel, energy


def segments(energy: np.ndarray, rise: float = OPEN, fall: float = CLOSE, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Runs of frames from one above `rise` to the last before one below `fall`."""
    state = np.where(energy >= rise, 1, np.where(energy < fall, -1, 0))
    decided = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (decided >= 0) & (state[np.maximum(decided, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= shortest]


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream: fixed-shape tensors of WINDOW x MELS (the last padded with the lowest value) with spans in seconds."""
    n = -(-len(mel) // WINDOW)
    full = np.full((n * WINDOW, MELS), np.float16(np.log(1e-6)))
    full[: len(mel)] = mel
    starts = np.arange(n) * WINDOW
    ends = np.minimum(starts + WINDOW, len(mel)) - 1
    table = pa.RecordBatch.from_arrays(
        [pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, WINDOW, MELS)), pa.array(starts * HOP / TARGET), pa.array((ends * HOP + FRAME) / TARGET)],
        names=["log_mel", "start_s", "end_s"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def features(rate: int, payload: bytes) -> tuple[bytes, int, list[dict]]:
    """Tensor stream, number of frames, and segments in seconds."""
    step = np.gcd(rate, TARGET)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, energy = log_mel(resample(x, int(TARGET // step), int(rate // step)))
    return tensors(mel), len(mel), [{"start_s": a * HOP / TARGET, "end_s": ((b - 1) * HOP + FRAME) / TARGET} for a, b in segments(energy)]


def audio_columns(df: DataFrame, id_col: str = "doc_id", payload_col: str = "payload", unit: int = UNIT) -> DataFrame:
    """Per row: the id, n_bytes (before padding), `media` (a RIFF file of the payload padded with 255 to a positive multiple of
    `unit`), `payload` (read back from it), `log_mel` (Arrow stream of tensors and spans), n_frames and `segments`."""
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("log_mel", pa.binary()), ("n_frames", pa.int64()), ("segments", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for key, raw in zip(b.column(0), b.column(1)):
                    raw = raw.as_py() or b""
                    n = max(unit, -(-len(raw) // unit) * unit)
                    media = wav(raw + bytes([PAD]) * (n - len(raw)))
                    rate, back = samples(media)
                    yield key.as_py(), len(raw), media, back, *features(rate, back)

        yield from rebatch(rows(), schema, lambda r: len(r[2]) + len(r[3]) + len(r[4]))

    return (
        df.select(df[id_col].alias("id"), df[payload_col].cast("binary").alias("payload"))
        .mapInArrow(tidy(run), "id long, n_bytes long, media binary, payload binary, log_mel binary, n_frames long, segments array<struct<start_s: double, end_s: double>>")
        .withColumnRenamed("id", id_col)
    )
