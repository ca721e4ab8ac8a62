"""Row types, constants of the PNG format (fixed values of the public standard) and error labels."""

from __future__ import annotations

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Samples a pixel, by colour type; and the bit depths that a colour type allows.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
COLOR_NAMES = {0: "grayscale", 2: "rgb", 3: "indexed", 4: "grayscale_alpha", 6: "rgba"}
INTERLACE_NAMES = {0: "none", 1: "adam7"}
FILTER_NAMES = {0: "none", 1: "sub", 2: "up", 3: "average", 4: "paeth"}
CRITICAL = ("IHDR", "PLTE", "IDAT", "IEND")
ANCILLARY = ("tRNS", "gAMA", "cHRM", "sRGB", "iCCP", "tEXt", "zTXt", "iTXt", "bKGD", "pHYs", "sBIT", "tIME")
# Adam7: x and y origins and steps of the seven passes.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
MAX_DIMENSION = 1_000_000_000
MAX_PIXELS = 4_000_000_000
MAX_CHUNK = 0x7FFFFFFF
MAX_IDAT_TOTAL = 256 << 20
MAX_FILE = 256 << 20
IDAT_PIECE = 32768

HEADER = "struct<width:bigint,height:bigint,bit_depth:int,color_type:int,compression:int,filter:int,interlace:int>"
PALETTE = "array<struct<r:int,g:int,b:int>>"
IMAGE = f"header {HEADER}, pixels binary, palette {PALETTE}, error string, detail string"


class ImageError(Exception):
    """A label of the error catalogue, with the finer label it stands for."""

    def __init__(self, label: str, detail: str | None = None):
        super().__init__(label)
        self.label, self.detail = label, detail or label
