"""Options of a conversion, resolved and checked once on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pagemill.operators.layout_kernel import Style

ELEMENTS = ("bold", "italic", "inlineCode", "codeBlock", "header", "bulletList", "link", "table", "image", "lineBreak")
STRATEGIES = ("lines_strict", "lines", "text", "explicit", "pixels")
TEXT_SOURCES = ("pdf", "ocr", "auto")


@dataclass(frozen=True)
class MarkdownOptions:
    """All settings; the names follow the usual option names in snake case.

    ``hdr_info``: False (no headings), None (sizes of the document), "toc" (the outline) or a
    callable from a span dict to a Markdown prefix. ``margins``: a number, (top, bottom) or (left, top, right, bottom).
    """

    pages: Sequence[int] | None = None
    hdr_info: Callable[[dict], str] | str | bool | None = None
    write_images: bool = False
    embed_images: bool = False
    image_path: str = ""
    image_format: str = "png"
    image_size_limit: float = 0.05
    filename: str = "document"
    force_text: bool = True
    page_separators: bool = False
    margins: float | Sequence[float] | None = None
    dpi: int = 150
    table_strategy: str = "lines_strict"
    text_source: str = "auto"
    ocr: Callable[[], object] | None = None
    detect_orientation: bool = True
    ocr_dpi: int = 300
    explicit_table_grids: Sequence[dict] | None = None
    fontsize_limit: float = 0.0
    ignore_code: bool = False
    extract_words: bool = False
    show_progress: bool = False
    ignore_alpha: bool = False
    remove_rotation: bool = True
    elements: Sequence[str] | None = None
    max_levels: int = 6
    body_limit: int = 12

    def __post_init__(self):
        if not (self.write_images or self.embed_images or self.force_text):
            raise ValueError("one of write_images, embed_images and force_text must be on")
        if self.table_strategy not in STRATEGIES:
            raise ValueError(f"unknown table strategy {self.table_strategy!r}")
        if self.text_source not in TEXT_SOURCES:
            raise ValueError(f"unknown text source {self.text_source!r}")
        if not 1 <= self.max_levels <= 6:
            raise ValueError("max_levels must be between 1 and 6")
        if self.elements is not None and (bad := set(self.elements) - set(ELEMENTS)):
            raise ValueError(f"unknown elements {sorted(bad)}")
        if self.image_format not in ("png", "jpg", "jpeg"):
            raise ValueError(f"unknown image format {self.image_format!r}")
        if isinstance(self.hdr_info, str) and self.hdr_info != "toc":
            raise ValueError(f"unknown heading source {self.hdr_info!r}")
        if not 0 <= self.image_size_limit < 1:
            raise ValueError("image_size_limit must be from 0 to under 1")
        self.margin_box  # noqa: B018  checks the margins

    def has(self, element: str) -> bool:
        return self.elements is None or element in self.elements

    @property
    def tables(self) -> bool:
        return self.has("table")

    @property
    def margin_box(self) -> tuple[float, float, float, float]:
        """Left, top, right and bottom margin."""
        m = self.margins
        if m is None:
            return 0.0, 0.0, 0.0, 0.0
        if isinstance(m, int | float):
            return (float(m),) * 4
        if len(m) == 2:
            return 0.0, float(m[0]), 0.0, float(m[1])
        if len(m) == 4:
            return tuple(map(float, m))
        raise ValueError("margins are a number, two or four numbers")

    @property
    def style(self) -> Style:
        code = not self.ignore_code
        return Style(self.has("bold"), self.has("italic"), code and self.has("inlineCode"), code and self.has("codeBlock"), self.has("header") and self.hdr_info is not False, self.has("bulletList"), self.has("link"))
