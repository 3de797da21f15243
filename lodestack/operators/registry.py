"""Named scanners and detectors that users add; each is a function over DataFrames, so their plans join the job's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodestack.functions import fixed
from lodestack.operators.extract import union_refs
from lodestack.shared import written

Scanner = Callable[[DataFrame], DataFrame]


class Registry:
    """Scanners and detectors by name, in the order in which they came."""

    def __init__(self) -> None:
        self.scanners: dict[str, Scanner] = {}
        self.detectors: dict[str, Callable[[], Column]] = {}
        self.failed: dict[str, str] = {}

    def register_scanner(self, name: str, scan: Scanner, override: bool = False) -> None:
        if name in self.scanners and not override:
            raise ValueError(f"there is a scanner {name} already")
        self.scanners[name] = scan

    def unregister_scanner(self, name: str) -> None:
        self.scanners.pop(name, None)

    def register_detector(self, name: str, detect: Callable[[], Column], override: bool = False) -> None:
        if name in self.detectors and not override:
            raise ValueError(f"there is a detector {name} already")
        self.detectors[name] = detect

    def run_scanners(self, files: DataFrame) -> DataFrame | None:
        """The rows of all scanners, each once. Each runs as a job of its own, whose result is written, so one that fails, in its plan or in a task, costs only
        its own rows; ``failed`` says why."""
        tables = []
        for name, scan in self.scanners.items():
            try:
                tables.append(written(scan(files)))
            except Exception as e:  # noqa: BLE001  a user's scanner may fail in any way
                self.failed[name] = str(e)
        return union_refs(*tables) if tables else None

    def run_detectors(self, pages: DataFrame) -> DataFrame:
        """``pages`` with ``detected``: the first detector's result that isn't null, and whose it is."""
        found = [F.when(c.isNotNull(), F.struct(F.lit(n).alias("by"), c.cast("string").alias("result"))) for n, c in ((n, d()) for n, d in self.detectors.items())]
        return pages.withColumn("detected", F.coalesce(*found)) if found else pages.withColumn("detected", F.lit(None).cast("struct<by:string,result:string>"))


@udtf(returnType="rule string, raw string", useArrow=True)
class AssetNames:
    """``SELECT ... FROM files, LATERAL asset_names(text)``: the quoted names and style references of assets in a text, each once, for SQL users."""

    def eval(self, text: str):
        import re

        ext = "|".join(fixed.ASSET_EXTENSIONS)
        rules = (("quoted", rf"""["'`]([^"'`\s<>{{}}|\\^$]{{1,400}}\.(?:{ext})(?:[?#][^"'`\s<>]*)?)["'`](?!\s*:)"""), ("css", r"""url\(\s*["']?([^"')\s]+?)["']?\s*\)"""))
        for rule, pattern in rules if text else ():
            for raw in dict.fromkeys(re.findall(pattern, text, re.I)):
                if not raw.startswith(("data:", "#")):
                    yield rule, raw


@udtf(returnType="ord int, raw string", useArrow=True)
class AnchorLinks:
    """``SELECT ... FROM pages, LATERAL anchor_links(html)``: the links of a page for SQL users."""

    def eval(self, html: str):
        import re

        if html:
            for k, m in enumerate(re.finditer(r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']""", html, re.I | re.S)):
                yield k, m.group(1)
