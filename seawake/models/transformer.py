"""An encoder-decoder transformer over trajectories, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.encode import positional_encoding
from .autograd import Tensor, parameter, wrap


def _linear(rng, n: int, m: int) -> list[Tensor]:
    bound = n**-0.5
    return [parameter(rng.uniform(-bound, bound, (n, m))), parameter(rng.uniform(-bound, bound, m))]


def _norm(x: Tensor, gain: Tensor, shift: Tensor, eps: float = 1e-5) -> Tensor:
    centred = x - x.mean(-1, keepdims=True)
    return centred * ((centred * centred).mean(-1, keepdims=True) + eps).power(-0.5) * gain + shift


def _check(x: Tensor, width: int) -> None:
    if x.data.ndim != 3 or x.shape[-1] != width:
        raise ValueError(f"the input has shape (batch, length, {width}), not {x.shape}")


def causal_mask(n: int) -> np.ndarray:
    """True where a place may not look: at later ones."""
    return np.triu(np.ones((n, n), bool), 1)


class Attention:
    def __init__(self, d_model: int, nhead: int, rng):
        if nhead < 1 or d_model % nhead:
            raise ValueError("d_model is a multiple of nhead")
        self.nhead, self.d = nhead, d_model // nhead
        self.parts = [_linear(rng, d_model, d_model) for _ in range(4)]

    def parameters(self) -> list[Tensor]:
        return [p for pair in self.parts for p in pair]

    def __call__(self, q: Tensor, kv: Tensor, mask: np.ndarray | None = None, padding: np.ndarray | None = None) -> Tensor:
        split = lambda x, w: (x @ w[0] + w[1]).reshape(x.shape[0], x.shape[1], self.nhead, self.d).transpose(0, 2, 1, 3)
        a, b, c = (split(x, w) for x, w in zip((q, kv, kv), self.parts, strict=False))
        scores = a @ b.transpose(0, 1, 3, 2) * self.d**-0.5
        hidden = np.zeros((q.shape[0], 1, q.shape[1], kv.shape[1]))
        if mask is not None:
            hidden = hidden + np.where(mask, -1e9, 0.0)
        if padding is not None:
            hidden = hidden + np.where(padding, -1e9, 0.0)[:, None, None, :]
        out = ((scores + hidden).softmax() @ c).transpose(0, 2, 1, 3).reshape(q.shape[0], q.shape[1], self.nhead * self.d)
        return out @ self.parts[3][0] + self.parts[3][1]


class Layer:
    """Self-attention, cross-attention (of a decoder) and two linear layers, each added and normalised; dropout while training."""

    def __init__(self, d_model: int, nhead: int, dim_feedforward: int, dropout: float, rng, cross: bool):
        if not 0 <= dropout < 1:
            raise ValueError("dropout is at least 0 and below 1")
        self.own = Attention(d_model, nhead, rng)
        self.cross = Attention(d_model, nhead, rng) if cross else None
        self.first, self.second = _linear(rng, d_model, dim_feedforward), _linear(rng, dim_feedforward, d_model)
        self.norms = [[parameter(np.ones(d_model)), parameter(np.zeros(d_model))] for _ in range(3 if cross else 2)]
        self.dropout, self.rng, self.training = dropout, rng, False

    def parameters(self) -> list[Tensor]:
        return self.own.parameters() + (self.cross.parameters() if self.cross else []) + self.first + self.second + [p for n in self.norms for p in n]

    def _drop(self, x: Tensor) -> Tensor:
        return x * ((self.rng.random(x.shape) >= self.dropout) / (1 - self.dropout)) if self.training and self.dropout else x

    def __call__(self, x: Tensor, memory: Tensor | None = None, mask=None, padding=None, memory_padding=None) -> Tensor:
        x = _norm(x + self._drop(self.own(x, x, mask, padding)), *self.norms[0])
        if self.cross:
            x = _norm(x + self._drop(self.cross(x, memory, None, memory_padding)), *self.norms[1])
        inner = (x @ self.first[0] + self.first[1]).relu()
        return _norm(x + self._drop(inner @ self.second[0] + self.second[1]), *self.norms[-1])


class TrajectoryEmbedding:
    """Linear, layer norm, plus the positional encoding; places under a mask are zero."""

    def __init__(self, input_dim: int, d_model: int, max_seq_len: int, rng):
        if min(input_dim, d_model, max_seq_len) < 1:
            raise ValueError("input_dim, d_model and max_seq_len are positive")
        self.input_dim, self.max_seq_len = input_dim, max_seq_len
        self.linear, self.norm = _linear(rng, input_dim, d_model), [parameter(np.ones(d_model)), parameter(np.zeros(d_model))]
        self.places = positional_encoding(max_seq_len, d_model)

    def parameters(self) -> list[Tensor]:
        return self.linear + self.norm

    def __call__(self, x, mask: np.ndarray | None = None) -> Tensor:
        x = wrap(x)
        _check(x, self.input_dim)
        if x.shape[1] > self.max_seq_len:
            raise ValueError(f"a sequence has at most {self.max_seq_len} places")
        out = _norm(x @ self.linear[0] + self.linear[1], *self.norm) + self.places[: x.shape[1]]
        return out if mask is None else out * np.asarray(mask, float)[..., None]


class _Stack:
    def __init__(self, d_model: int, nhead: int, num_layers: int, dim_feedforward: int, dropout: float, rng, cross: bool):
        if num_layers < 1 or dim_feedforward < 1:
            raise ValueError("num_layers and dim_feedforward are positive")
        self.d_model = d_model
        self.layers = [Layer(d_model, nhead, dim_feedforward, dropout, rng, cross) for _ in range(num_layers)]

    def parameters(self) -> list[Tensor]:
        return [p for layer in self.layers for p in layer.parameters()]


class TrajectoryEncoder(_Stack):
    def __init__(self, d_model=256, nhead=8, num_layers=3, dim_feedforward=1024, dropout=0.1, rng=None):
        super().__init__(d_model, nhead, num_layers, dim_feedforward, dropout, rng or np.random.default_rng(0), False)

    def __call__(self, x, mask=None, padding=None) -> Tensor:
        x = wrap(x)
        _check(x, self.d_model)
        for layer in self.layers:
            x = layer(x, None, mask, padding)
        return x


class TrajectoryDecoder(_Stack):
    def __init__(self, d_model=256, nhead=8, num_layers=3, dim_feedforward=1024, dropout=0.1, rng=None):
        super().__init__(d_model, nhead, num_layers, dim_feedforward, dropout, rng or np.random.default_rng(0), True)

    def __call__(self, x, memory, mask=None, padding=None, memory_padding=None) -> Tensor:
        x, memory = wrap(x), wrap(memory)
        _check(x, self.d_model)
        _check(memory, self.d_model)
        if x.shape[0] != memory.shape[0]:
            raise ValueError("target and memory have as many rows")
        for layer in self.layers:
            x = layer(x, memory, mask, padding, memory_padding)
        return x


class TrajectoryTransformer:
    """embed, encode, decode the same embedding against it, and a linear layer back to the features."""

    def __init__(self, d_model=256, nhead=8, num_encoder_layers=3, num_decoder_layers=3, dim_feedforward=1024, dropout=0.1, max_seq_len=1000, include_speed=True, include_orientation=True, include_timestamps=True, seed=0):
        rng = np.random.default_rng(seed)
        self.input_dim = 2 + include_speed + 2 * include_orientation + include_timestamps
        self.embedding = TrajectoryEmbedding(self.input_dim, d_model, max_seq_len, rng)
        self.encoder = TrajectoryEncoder(d_model, nhead, num_encoder_layers, dim_feedforward, dropout, rng)
        self.decoder = TrajectoryDecoder(d_model, nhead, num_decoder_layers, dim_feedforward, dropout, rng)
        self.output = _linear(rng, d_model, self.input_dim)

    def parameters(self) -> list[Tensor]:
        return self.embedding.parameters() + self.encoder.parameters() + self.decoder.parameters() + self.output

    def train(self, on: bool = True) -> None:
        for layer in self.encoder.layers + self.decoder.layers:
            layer.training = on

    def __call__(self, x, attention: np.ndarray | None = None) -> Tensor:
        padding = None if attention is None else ~np.asarray(attention, bool)
        embedded = self.embedding(x)
        memory = self.encoder(embedded, None, padding)
        return self.decoder(embedded, memory, None, padding, padding) @ self.output[0] + self.output[1]


def predict(model: TrajectoryTransformer, df: DataFrame, column: str = "masked", attention: str | None = "attention") -> DataFrame:
    """Adds predicted to rows with arrays of features: batch inference, the model sent once per task."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", predicted array<array<float>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for b in batches:
            made = []
            for i in range(len(b)):  # rows may differ in length
                x = np.array([list(v) for v in b[column].iloc[i]], float)[None]
                a = None if attention is None else np.array(list(b[attention].iloc[i]), bool)[None]
                made.append(net(x, a).data[0].astype(np.float32).tolist())
            yield b.assign(predicted=made)[[*names, "predicted"]]

    return df.mapInPandas(run, schema)
