"""Whole VP9 frame headers along a stream: what a frame takes over from the frames before it is carried as state.

The state of a stream is small: the size of each of the eight reference slots, the loop filter's deltas and the features of
the segments. A stream is read once in order (folds.ordered_fold).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .folds import ordered_fold

# Fixed values of the format: sync code, interpolation filters by their two bits, bits and signs of segment features.
SYNC = 0x498342
FILTERS = ["smooth", "regular", "sharp", "bilinear"]
FEATURE_BITS, FEATURE_SIGNED = [8, 6, 2, 0], [True, True, False, False]

#: Columns that frame_headers() adds.
COLUMNS = (
    "error string, shows_existing int, key_frame boolean, show_frame boolean, error_resilient boolean, intra_only boolean, refresh int, "
    "width int, height int, render_width int, render_height int, refs array<int>, sign_biases array<int>, size_from int, high_precision boolean, filter string, "
    "context int, filter_level int, sharpness int, ref_deltas array<int>, mode_deltas array<int>, base_q int, q_deltas array<int>, "
    "segmented boolean, segment_features int, tile_columns_log2 int, tile_rows_log2 int, first_partition_size int, header_bytes int"
)
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def __call__(self, n: int = 1) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("truncated header")
        value = 0
        for i in range(self.at, self.at + n):
            value = value << 1 | self.data[i >> 3] >> (7 - (i & 7)) & 1
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self(n)
        return -value if self() else value


def _plain_features() -> dict[tuple[int, int], int]:
    return {}


@dataclass
class References:
    """What later frames of a stream may take over."""

    sizes: list[tuple[int, int] | None] = field(default_factory=lambda: [None] * 8)
    ref_deltas: tuple[int, ...] = (1, 0, -1, -1)
    mode_deltas: tuple[int, ...] = (0, 0)
    features: dict[tuple[int, int], int] = field(default_factory=_plain_features)
    begun: bool = False

    def step(self, payload: bytes | None) -> list:
        """The columns of a frame. A broken frame has its error only and leaves the state as it is."""
        out = dict.fromkeys(_NAMES)
        try:
            self._read(_Bits(bytes(payload or b"")), out)
        except ValueError as e:
            return [str(e) if n == "error" else None for n in _NAMES]
        return [out[n] for n in _NAMES]

    def _read(self, bit: _Bits, out: dict) -> None:
        if bit(2) != 2:
            raise ValueError("no frame marker")
        if bit() | bit() << 1:
            raise ValueError("profile not supported")
        if bit():
            out["shows_existing"] = bit(3)
            out["width"], out["height"] = self.sizes[out["shows_existing"]] or (None, None)
            return
        key, shown, resilient = not bit(), bool(bit()), bool(bit())
        intra = False
        size = lambda: (bit(16) + 1, bit(16) + 1)
        render = lambda coded: size() if bit() else coded

        def sync() -> None:
            if bit(24) != SYNC:
                raise ValueError("no sync code")

        if key:
            sync()
            if bit(3) == 7:
                raise ValueError("colour space not supported")
            bit()
            refresh, coded = 0xFF, size()
            shown_size = render(coded)
        else:
            intra = not shown and bool(bit())
            if not resilient:
                bit(2)
            if intra:
                sync()
                refresh, coded = bit(8), size()
                shown_size = render(coded)
            else:
                refresh = bit(8)
                pairs = [(bit(3), bit()) for _ in range(3)]
                out["refs"], out["sign_biases"] = [r for r, _ in pairs], [s for _, s in pairs]
                coded = None
                for slot in out["refs"]:
                    if bit():
                        coded, out["size_from"] = self.sizes[slot], slot
                        if coded is None:
                            raise ValueError("size of an empty reference")
                        break
                coded = coded or size()
                shown_size = render(coded)
                out["high_precision"] = bool(bit())
                out["filter"] = "switchable" if bit() else FILTERS[bit(2)]
        if not resilient:
            bit(2)
        out["context"] = bit(2)
        anew = key or intra or resilient or not self.begun
        refs, modes = ((1, 0, -1, -1), (0, 0)) if anew else (self.ref_deltas, self.mode_deltas)
        features = {} if anew else dict(self.features)
        out["filter_level"], out["sharpness"] = bit(6), bit(3)
        if bit() and bit():
            refs, modes = (tuple(bit.signed(6) if bit() else d for d in deltas) for deltas in (refs, modes))
        out["base_q"] = bit(8)
        out["q_deltas"] = [bit.signed(4) if bit() else 0 for _ in range(3)]
        out["segmented"] = bool(bit())
        if out["segmented"]:
            if bit():
                for _ in range(7):
                    if bit():
                        bit(8)
                temporal = bit()
                for _ in range(3):
                    if temporal and bit():
                        bit(8)
            if bit():
                bit()
                features = {}
                for segment in range(8):
                    for k, (n, signed) in enumerate(zip(FEATURE_BITS, FEATURE_SIGNED, strict=True)):
                        if bit():
                            features[segment, k] = bit.signed(n) if signed else bit(n)
        blocks = (coded[0] + 63) // 64
        low = max(0, (blocks - 1).bit_length() - 6)
        high = max(0, blocks.bit_length() - 3)
        columns = low
        while columns < high and bit():
            columns += 1
        rows = bit()
        rows += bit() if rows else 0
        first = bit(16)
        if not first:
            raise ValueError("empty first partition")
        out |= {
            "key_frame": key, "show_frame": shown, "error_resilient": resilient, "intra_only": intra, "refresh": refresh,
            "width": coded[0], "height": coded[1], "render_width": shown_size[0], "render_height": shown_size[1],
            "ref_deltas": list(refs), "mode_deltas": list(modes), "segment_features": len(features),
            "tile_columns_log2": columns, "tile_rows_log2": rows, "first_partition_size": first, "header_bytes": (bit.at + 7) // 8,
        }
        # Only a whole header changes what later frames see.
        self.ref_deltas, self.mode_deltas, self.features, self.begun = refs, modes, features, True
        self.sizes = [coded if refresh >> i & 1 else s for i, s in enumerate(self.sizes)]


def frame_headers(df: DataFrame, by: str, order: list[str], payload: str) -> DataFrame:
    """Adds COLUMNS to the frames of streams; a frame that cannot be read has `error` and nulls."""
    return ordered_fold(df, by, order, [payload], References, lambda s, p: s.step(p), COLUMNS)
