"""Settings, directives in sources, archives."""

from __future__ import annotations

import gzip
import hashlib
import io
import posixpath
import re
import tarfile
import zlib
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Name of the settings file of a library.
SETTINGS = "library.toml"
HEAD_LINES = 20
#: A directive is a comment that opens with `!` and the upper-case name of the tool it is for.
DIRECTIVE = re.compile(r"^[ \t]*%\s*!\s*([A-Z]+)\s+(.*?)\s*$", re.M)


class BadSettings(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    root: Path
    seeds: tuple[str, ...] = ()
    bibs: tuple[str, ...] = ()
    depth: int = 1
    subjects: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    cap: int = 60
    store: str = "index"
    extra: dict = field(default_factory=dict, compare=False)

    def fingerprint(self, texts: list[str]) -> str:
        """Digest of what decides a plan; the cap does not."""
        lines = [f"depth={self.depth}", *[f"subject={s}" for s in sorted(self.subjects)], *[f"category={c}" for c in sorted(self.categories)], *[f"seed={s}" for s in self.seeds]]
        return hashlib.sha256(("\n".join(lines) + "\0" + "\0".join(texts)).encode()).hexdigest()


def find_root(start: Path) -> Path | None:
    return next((p for p in (start, *start.parents) if (p / SETTINGS).is_file()), None)


def load_settings(start: Path) -> Settings:
    root = find_root(start)
    if root is None:
        raise BadSettings(f"no {SETTINGS} here or above")
    raw = tomllib.loads((root / SETTINGS).read_text(encoding="utf-8"))
    crawl = raw.get("crawl", {})
    out = Settings(root, tuple(crawl.get("seeds", ())), tuple(crawl.get("bibs", ())), crawl.get("depth", 1), tuple(crawl.get("subjects", ())), tuple(crawl.get("categories", ())), crawl.get("cap", 60), raw.get("index", {}).get("path", "index"), raw)
    if out.depth < 1:
        raise BadSettings("depth must be at least 1")
    if not out.seeds and not out.bibs:
        raise BadSettings("no seeds")
    for b in out.bibs:
        if not (root / b).is_file():
            raise BadSettings(f"no such bibliography: {b}")
    return out


def write_template(root: Path) -> Path:
    path = root / SETTINGS
    if path.exists():
        raise FileExistsError(path)
    root.mkdir(parents=True, exist_ok=True)
    path.write_text('[crawl]\nseeds = []\nbibs = []\ndepth = 1\nsubjects = []\ncategories = []\ncap = 60\n', encoding="utf-8")
    return path


def directives(text: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, key, value): kind is kv, begin, end, bare, tex or unknown."""
    out = []
    for m in DIRECTIVE.finditer(text):
        line, body = text.count("\n", 0, m.start()) + 1, m[2]
        if m[1] == "TEX":
            key, _, value = body.partition("=")
            out.append((line, "tex", key.strip().lower(), value.strip()))
        elif b := re.match(r"(begin|end)\s+(\S+)$", body):
            out.append((line, b[1], b[2], ""))
        elif kv := re.match(r"([A-Za-z][\w-]*)\s*:\s*(.*)$", body):
            out.append((line, "kv", kv[1].lower(), kv[2]))
        else:
            out.append((line, "bare" if re.fullmatch(r"[\w-]+", body) else "unknown", body, ""))
    return out


def header(text: str) -> dict[str, str]:
    """Key-value directives of the first lines."""
    return {k: v for line, kind, k, v in directives("\n".join(text.split("\n")[:HEAD_LINES])) if kind == "kv"}


def is_digest(text: str) -> bool:
    return "digest" in header(text)


def listed(value: str) -> list[str]:
    return [x.strip() for x in value.split(",") if x.strip()]


def required_packages(text: str) -> list[str]:
    return listed(header(text).get("requires", ""))


def macro_block(text: str) -> str:
    m = re.search(r"(?ms)^%\s*![A-Z]+ begin macros\s*\n(.*?)^%\s*![A-Z]+ end macros", text)
    return m[1] if m else ""


def loaded_packages(text: str) -> set[str]:
    found = re.findall(r"\\(?:usepackage|RequirePackage)\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}", text)
    return {p for group in found for p in listed(group)}


def unpack(data: bytes) -> dict[str, bytes]:
    """Files of a download: a tar archive, one compressed file, or a PDF. Links and paths that escape are refused."""
    if data[:5] == b"%PDF-":
        return {"paper.pdf": data}
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            out = {}
            for m in tar.getmembers():
                name = posixpath.normpath(m.name)
                if m.isdir():
                    continue
                if not m.isfile() or name.startswith(("/", "..")):
                    raise ValueError(f"refused: {m.name}")
                out[name] = tar.extractfile(m).read()
            return out
    except tarfile.ReadError:
        return {"main.tex": data}


def unpack_archives(spark: SparkSession, root: str) -> DataFrame:
    """(version, path, content, error) of every archive below root; the version is the archive's folder. An archive that cannot be
    read is one row with the error, and the others are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                version = path.rsplit("/", 2)[-2]
                try:
                    rows = [(version, name, data, None) for name, data in unpack(bytes(content)).items()]
                except (OSError, EOFError, ValueError, zlib.error, tarfile.TarError) as exc:
                    rows = [(version, None, None, f"{type(exc).__name__}: {exc}")]
                yield pd.DataFrame(rows, columns=["version", "path", "content", "error"])

    return found.mapInPandas(run, "version string, path string, content binary, error string")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(home, path, content): files below the `src` folders of a library, the home being the folder that holds `src`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where("path like '%/src/%'").selectExpr("regexp_extract(path, '^(.*?)/src/', 1) as home", "regexp_extract(path, '/src/(.*)$', 1) as path", "content")


def prefixes(spark: SparkSession, root: str) -> DataFrame:
    """(home, prefix): the prefix a digest's header states, for every folder that holds one."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "digest.tex").text(root, wholetext=True).selectExpr("regexp_replace(_metadata.file_path, '/[^/]*$', '') as home", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"home": pdf["home"], "prefix": [header(v).get("prefix", "") for v in pdf["value"]]})

    return found.mapInPandas(run, "home string, prefix string").where("prefix <> ''")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(home, local, kind): what is on disk of each version: unpacked sources or a paper."""
    listed_ = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    kind = "case when path like '%/src/%' then 'source' else 'pdf' end as kind"
    return listed_.where("path rlike '/(src/.*|paper[.]pdf)$'").selectExpr("regexp_extract(path, '^(.*?)/([^/]+)/(src/.*|paper[.]pdf)$', 1) as home", "regexp_extract(path, '^(.*?)/([^/]+)/(src/.*|paper[.]pdf)$', 2) as local", kind).distinct()


def seeds(spark: SparkSession, settings: Settings) -> DataFrame:
    """(pos, label, id): identifiers first, then the entries of the bibliographies in order; id empty if none is stated."""
    from . import bibtex

    rows = []
    for s in settings.seeds:
        scheme, _, value = s.partition(":")
        if not scheme or not value.strip():
            raise BadSettings(f"not an identifier: {s}")
        rows.append((len(rows), s, s))
    for b in settings.bibs:
        for key, (_, fields) in bibtex.entries((settings.root / b).read_text(encoding="utf-8")).items():
            rows.append((len(rows), key, next(iter(bibtex.declared(fields)), "")))
    return spark.createDataFrame(rows, "pos int, label string, id string")
