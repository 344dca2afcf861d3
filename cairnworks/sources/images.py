"""Difference hashes and thumbnails of image bytes, where Pillow is installed."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.functions.bits import difference_hash

try:
    from PIL import Image
except ImportError:  # an extra; only the functions below need it
    Image = None

SIZE = 8
THUMB = 160


def _need_pillow() -> None:
    if Image is None:
        raise RuntimeError("Pillow is not installed; give pixel arrays to difference_hash instead")


Decoder = Callable[[bytes], tuple[list[int], int, int]]


def pillow_decoder() -> Decoder:
    """Gives 9 x 8 grey values in rows, width and height of an image's bytes, by Pillow."""
    _need_pillow()

    def decode(content: bytes) -> tuple[list[int], int, int]:
        with Image.open(io.BytesIO(content)) as im:
            grey = im.convert("L").resize((SIZE + 1, SIZE), Image.LANCZOS)
            return list(grey.tobytes()), *im.size

    return decode


def image_signatures(images: DataFrame, decoder: Decoder | None = None) -> DataFrame:
    """images(hash, content) to (hash, sig, w, h); what can't be decoded is left out."""
    decode = decoder or pillow_decoder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, content in zip(batch["hash"], batch["content"], strict=True):
                try:
                    out.append((key, *decode(bytes(content))))
                except Exception:  # noqa: BLE001  decoders raise what they like
                    continue
            yield pd.DataFrame(out, columns=["hash", "pixels", "w", "h"])

    pixels = images.select("hash", "content").mapInPandas(run, "hash string, pixels array<int>, w int, h int")
    return pixels.select("hash", difference_hash(F.col("pixels"), SIZE).alias("sig"), "w", "h")


def thumbnails(images: DataFrame) -> DataFrame:
    """images(hash, content) to (hash, jpeg) within 160 x 160; what can't be decoded is left out."""
    _need_pillow()

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, content in zip(batch["hash"], batch["content"], strict=True):
                try:
                    with Image.open(io.BytesIO(bytes(content))) as im:
                        im = im.convert("RGB")
                        im.thumbnail((THUMB, THUMB))
                        held = io.BytesIO()
                        im.save(held, "JPEG", quality=80)
                        out.append((key, held.getvalue()))
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(out, columns=["hash", "jpeg"])

    return images.select("hash", "content").mapInPandas(shrink, "hash string, jpeg binary")
