"""City-model files: hardened scan, code lists, byte-preserving rewrite.

A file is read once by an event parser that reports byte offsets, so one pass
gives the span of every member, its attribute paths, its geometry and a digest
of it.  Files of one dataset are rows (``binaryFile``); members are rows after
the scan, so later steps no longer depend on how large a file is.
"""

from __future__ import annotations

import re
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakewright.operators.polygons import shape_key

# Namespaces whose elements carry no attributes, and what counts as a building.
GML = "http://www.opengis.net/gml"
APPEARANCE = "http://www.opengis.net/citygml/appearance/2.0"
BUILDING = ("http://www.opengis.net/citygml/building/1.0", "http://www.opengis.net/citygml/building/2.0")
FOOTPRINTS = ("lod0FootPrint", "lod0RoofEdge", "GroundSurface")

SCAN = (
    "file string, gml_id string, start long, stop long, attrs array<struct<path:string,value:string,code_space:string,uom:string>>, "
    "geom_hash string, rings array<struct<footprint:boolean,n:int,pts:array<struct<a:double,b:double,z:double>>>>"
)


class UnsafeXml(ValueError):
    """The document declares a type or an entity."""


def canonical_number(text: str) -> str:
    """A decimal number in plain canonical form; other text unchanged."""
    try:
        n = Decimal(text)
    except InvalidOperation:
        return text
    return format(n.normalize(), "f") if n.is_finite() else text


def event_parser() -> expat.XMLParserType:
    """A namespace-aware parser that refuses document types, entities and anything external."""
    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = True

    def refuse(*_):
        raise UnsafeXml("document types and entities are not accepted")

    p.StartDoctypeDeclHandler = p.EntityDeclHandler = p.ExternalEntityRefHandler = refuse
    return p


@dataclass
class Member:
    gml_id: str
    start: int
    stop: int
    attrs: list[tuple[str, str, str | None, str | None]]
    geom_hash: str | None
    rings: list[tuple[bool, int, list[tuple[float, float, float]] | None]]


@dataclass
class _Open:
    name: str
    path: str
    skipped: bool
    text: list[str] = field(default_factory=list)
    children: int = 0
    code_space: str | None = None
    uom: str | None = None


class _Scan:
    """Collects one member after the other while the parser runs."""

    def __init__(self, raw: bytes):
        self.raw, self.members, self.stack = raw, [], []
        self.member_start = self.depth_of_building = -1
        self.p = event_parser()
        self.p.StartElementHandler, self.p.EndElementHandler = self.opened, self.closed
        self.p.CharacterDataHandler = lambda s: self.stack and self.stack[-1].text.append(s)

    def run(self) -> list[Member]:
        self.p.Parse(self.raw, True)
        return self.members

    def opened(self, tag: str, attributes: dict) -> None:
        ns, _, name = tag.rpartition(" ")
        plain = {k.rpartition(" ")[2]: v for k, v in attributes.items()}
        above = self.stack[-1] if self.stack else None
        if above:
            above.children += 1
        if name == "cityObjectMember" and self.depth_of_building < 0:
            self.member_start = self.p.CurrentByteIndex
        if name == "Building" and ns in BUILDING and self.depth_of_building < 0:
            self.depth_of_building = len(self.stack)
            self.gml_id, self.attrs, self.faces, self.rings = plain.get("id"), [], [], []
            self.stack.append(_Open(name, "", False))
            return
        step = f"{name}[@name={plain['name']}]" if plain.get("name") else name
        inside = above is not None and self.depth_of_building >= 0
        skipped = (above.skipped if inside else False) or ns in (GML, APPEARANCE)
        self.stack.append(_Open(name, f"{above.path}/{step}" if inside else "", skipped, code_space=plain.get("codeSpace"), uom=plain.get("uom")))

    def closed(self, tag: str) -> None:
        ns, _, name = tag.rpartition(" ")
        own = self.stack.pop()
        if self.depth_of_building >= 0:
            text = "".join(own.text).strip()
            if len(self.stack) == self.depth_of_building:
                self.finish()
                return
            if not own.skipped and not own.children and text:
                self.attrs.append((own.path, text, own.code_space, own.uom))
            if ns == GML and name in ("posList", "pos") and text:
                tokens = text.split()
                self.faces.append(" ".join(map(canonical_number, tokens)))
                if any(o.name == "LinearRing" for o in self.stack[self.depth_of_building :]):
                    self.ring(tokens)
        elif name == "cityObjectMember":
            end = self.raw.index(b">", self.p.CurrentByteIndex) + 1
            for m in self.members:
                if m.stop < 0:
                    m.stop = end

    def ring(self, tokens: list[str]) -> None:
        low = any(o.name in FOOTPRINTS for o in self.stack[self.depth_of_building :])
        points = None
        if len(tokens) % 3 == 0:
            try:
                v = [float(t) for t in tokens]
                points = list(zip(v[::3], v[1::3], v[2::3]))
            except ValueError:
                points = None
        self.rings.append((low, len(tokens), points))

    def finish(self) -> None:
        self.depth_of_building = -1
        if self.gml_id is None:
            return
        digest = hashlib.sha256("\n".join(sorted(self.faces)).encode()).hexdigest() if self.faces else None
        self.members.append(Member(self.gml_id, self.member_start, -1, self.attrs, digest, self.rings))


def scan(raw: bytes) -> list[Member]:
    """The buildings of one file in document order; those without an id are skipped."""
    return _Scan(raw).run()


def indexed(attrs: list[tuple]) -> dict[str, str]:
    """Attributes as a map; paths that repeat get ``[i]`` in document order."""
    count: dict[str, int] = {}
    for path, *_ in attrs:
        count[path] = count.get(path, 0) + 1
    seen: dict[str, int] = {}
    out = {}
    for path, value, *_ in attrs:
        i = seen[path] = seen.get(path, -1) + 1
        out[path if count[path] == 1 else f"{path}[{i}]"] = value
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of every file under ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def scan_files(files: DataFrame) -> DataFrame:
    """Rows ``SCAN`` of files (file, content); a repeated id keeps its last member in the file."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["file"], pdf["content"]):
                out = [
                    {
                        "file": name, "gml_id": m.gml_id, "start": m.start, "stop": m.stop,
                        "attrs": [{"path": a, "value": v, "code_space": c, "uom": u} for a, v, c, u in m.attrs], "geom_hash": m.geom_hash,
                        "rings": [{"footprint": f, "n": n, "pts": None if p is None else [{"a": a, "b": b, "z": z} for a, b, z in p]} for f, n, p in m.rings],
                    }
                    for m in scan(bytes(raw))
                ]
                if out:
                    yield pd.DataFrame(out)

    found = files.select("file", "content").mapInPandas(rows, SCAN)
    last = F.row_number().over(Window.partitionBy("file", "gml_id").orderBy(F.desc("start")))
    return found.withColumn("_last", last).where("_last = 1").drop("_last")


def attributes(members: DataFrame) -> DataFrame:
    """(file, gml_id, path, value, code_space, uom) with indices on repeated paths."""
    long = members.select("file", "gml_id", F.posexplode("attrs").alias("ord", "a")).select("file", "gml_id", "ord", "a.*")
    w = Window.partitionBy("file", "gml_id", "path")
    i, n = F.row_number().over(w.orderBy("ord")) - 1, F.count(F.lit(1)).over(w)
    return long.withColumn("path", F.when(n > 1, F.concat("path", F.lit("["), i.cast("string"), F.lit("]"))).otherwise(F.col("path"))).drop("ord")


def footprints(members: DataFrame) -> DataFrame:
    """(id, rings, fingerprint) of scanned members, ready to be matched; without a readable footprint rings are empty and the fingerprint is null."""
    rings = F.transform(F.filter("rings", lambda r: r["footprint"] & r["pts"].isNotNull()), lambda r: r["pts"])
    own = members.select(F.col("gml_id").alias("id"), rings.alias("rings"))
    return own.withColumn("fingerprint", F.when(F.size("rings") > 0, shape_key("rings")))


def code_list(raw: bytes) -> dict[str, str]:
    """{code: label} of one dictionary file."""
    out: dict[str, str] = {}
    state: dict = {"open": [], "text": ""}

    def opened(tag, _):
        state["open"].append(tag.rpartition(" ")[2])
        state["text"] = ""
        if state["open"][-1] == "Definition":
            state["code"], state["label"] = None, ""

    def closed(tag):
        name = state["open"].pop()
        if state["open"] and state["open"][-1] == "Definition" and name in ("name", "description"):
            state["code" if name == "name" else "label"] = state["text"].strip()
        if name == "Definition" and state["code"] is not None:
            out[state["code"]] = state["label"]

    p = event_parser()
    p.StartElementHandler, p.EndElementHandler = opened, closed
    p.CharacterDataHandler = lambda s: state.__setitem__("text", state["text"] + s)
    p.Parse(raw, True)
    return out


def scan_code_lists(files: DataFrame) -> DataFrame:
    """(list, code, label) of dictionary files; a malformed file is skipped."""

    def rows(batches):
        for pdf in batches:
            for name, raw in zip(pdf["file"], pdf["content"]):
                try:
                    codes = code_list(bytes(raw))
                except (expat.ExpatError, UnsafeXml):
                    continue
                yield pd.DataFrame({"list": [name.rsplit("/", 1)[-1]] * len(codes), "code": list(codes), "label": list(codes.values())})

    return files.select("file", "content").mapInPandas(rows, "list string, code string, label string")


def _verdict(raw: bytes) -> str:
    try:
        event_parser().Parse(raw, True)
    except UnsafeXml:
        return "refused"
    except expat.ExpatError:
        return "malformed"
    return "ok"


def xml_verdict(content: Column) -> Column:
    """ok, refused (a document type or entities) or malformed, for documents as bytes."""
    return F.pandas_udf(lambda s: s.map(lambda x: _verdict(bytes(x))), "string")(content)


def serialise(body: str) -> bytes:
    """A document as it is published: byte-order mark, declaration, CRLF."""
    text = '<?xml version="1.0" encoding="UTF-8"?>\n' + body
    return b"\xef\xbb\xbf" + text.replace("\r\n", "\n").replace("\n", "\r\n").encode()


def rebuild(base: bytes, head: bytes) -> bytes:
    """``base`` with only the members that differ in meaning taken from ``head``.

    Bytes of unchanged members, and everything between members, stay as they
    are.  Added members go before the end of the document.  The result is
    checked: scanned again it must equal ``head`` member by member.
    """
    meaning = lambda m: (tuple(sorted((k, canonical_number(v)) for k, v in indexed(m.attrs).items())), m.geom_hash)
    old, new = {m.gml_id: m for m in scan(base)}, {m.gml_id: m for m in scan(head)}
    edits = []
    for i, m in old.items():
        if i not in new:
            edits.append((m.start, m.stop, b""))
        elif meaning(m) != meaning(new[i]):
            edits.append((m.start, m.stop, head[new[i].start : new[i].stop]))
    added = b"".join(head[m.start : m.stop] + b"\n" for i, m in new.items() if i not in old)
    if added:
        at = base.rindex(b"</")
        edits.append((at, at, added))
    out = base
    for start, stop, piece in sorted(edits, reverse=True):
        out = out[:start] + piece + out[stop:]
    if {m.gml_id: meaning(m) for m in scan(out)} != {i: meaning(m) for i, m in new.items()}:
        raise ValueError("the rebuilt file differs from the target in meaning")
    return out


def keep_members(raw: bytes, ids: set[str]) -> bytes:
    """``raw`` without the members whose id is not in ``ids``; all other bytes stay, which is checked."""
    members = scan(raw)
    out, at = [], 0
    for m in members:
        if m.gml_id not in ids:
            out.append(raw[at : m.start])
            at = m.stop
    made = b"".join([*out, raw[at:]])
    pieces = lambda data, own: [(m.gml_id, data[m.start : m.stop]) for m in own]
    if pieces(made, scan(made)) != [p for p in pieces(raw, members) if p[0] in ids]:
        raise ValueError("the members that stay differ from the source")
    return made


def extract_files(files: DataFrame, keep: DataFrame) -> DataFrame:
    """(file, content) of files with the members (file, gml_id) of ``keep`` only, byte for byte; a file keeps none that are not named."""
    named = keep.groupBy("file").agg(F.collect_set("gml_id").alias("_ids"))  # no more than a file has members

    @F.pandas_udf("binary")
    def cut(content: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([keep_members(bytes(x), set() if own is None else set(own)) for x, own in zip(content, ids)])

    return files.join(named, "file", "left").select("file", cut("content", "_ids").alias("content"))


#: Names of the elements that hold the second level of detail or more: solids, surfaces, curves, bounding surfaces, rooms, installations.
DETAIL = r"(?:lod[2-9]\w*|boundedBy|interiorRoom|outerBuildingInstallation|interiorBuildingInstallation|appearanceMember|appearance)"


_TAG = re.compile(rb"""<(?:"[^"]*"|'[^']*'|[^"'>])*>""")


def without_elements(raw: bytes, names: str = DETAIL) -> bytes:
    """``raw`` without the outermost elements whose local name matches ``names``; all other bytes stay.

    ``boundedBy`` counts only inside a member, not where it holds the envelope of a document.
    """
    match, cuts, path = re.compile(names).fullmatch, [], []
    p = event_parser()

    def start(name, _):
        space, _, local = name.rpartition(" ")
        path.append((p.CurrentByteIndex, bool(match(local)) and not (local == "boundedBy" and space.endswith("/gml")) and not any(hit for _, hit in path)))

    def end(_):
        begin, hit = path.pop()
        if hit:
            # an empty element ends with its start tag, and the parser then stands behind it
            opened = _TAG.match(raw, begin).end()
            cuts.append((begin, opened if raw[opened - 2 : opened] == b"/>" else raw.index(b">", p.CurrentByteIndex) + 1))

    p.StartElementHandler, p.EndElementHandler = start, end
    p.Parse(raw, True)
    out, at = [], 0
    for begin, stop in cuts:
        out.append(raw[at:begin])
        at = stop
    return b"".join([*out, raw[at:]])


def lite_files(files: DataFrame) -> DataFrame:
    """(file, content) without detail, written byte for byte otherwise."""

    @F.pandas_udf("binary")
    def lite(content: pd.Series) -> pd.Series:
        return pd.Series([without_elements(bytes(x)) for x in content])

    return files.select("file", lite("content").alias("content"))


def require_supported(found: DataFrame, allowed: DataFrame, name: str = "name") -> None:
    """Stop if ``found`` has a name that ``allowed`` lacks; at most ten are told."""
    unknown = [r[0] for r in found.select(name).distinct().join(allowed.select(name), name, "left_anti").orderBy(name).limit(10).collect()]
    if unknown:
        raise ValueError(f"names without a rule, so nothing is converted: {', '.join(map(str, unknown))}")


def rename_elements(raw: bytes, old: str, new: str, targets: set[str] | None = None) -> tuple[bytes, list[str], list[tuple[str, str]]]:
    """``raw`` with direct properties ``old`` of buildings renamed to ``new``: bytes, ids changed, (id, reason) left out.

    Only the name tokens change.  A building that already has ``new``, or has no
    ``old``, is left out; one with both, or with several, stops the edit.
    """
    edits: dict[str, list[int]] = {}
    has: dict[str, list[int]] = {}
    order: list[str] = []
    stack: list[str] = []
    p = event_parser()

    def at_name() -> int:
        return raw.index(old.encode(), p.CurrentByteIndex)

    def opened(tag, attributes):
        ns, _, name = tag.rpartition(" ")
        if name == "Building" and ns in BUILDING:
            order.append(next((v for k, v in attributes.items() if k.rpartition(" ")[2] == "id"), ""))
            has[order[-1]] = [0, 0]
        elif stack and stack[-1] == "Building" and name in (old, new):
            has[order[-1]][name == new] += 1
            if name == old:
                edits.setdefault(order[-1], []).append(at_name())
        stack.append(name)

    def closed(tag):
        name = stack.pop()
        if name == old and stack and stack[-1] == "Building":
            edits[order[-1]].append(at_name())

    p.StartElementHandler, p.EndElementHandler = opened, closed
    p.Parse(raw, True)
    if any(a > 1 or b > 1 or (a and b) for a, b in has.values()):
        raise ValueError("a building has several of the properties")
    left = [(i, "already-renamed" if has[i][1] else "absent") for i in order if not has[i][0]]
    chosen = [i for i in order if has[i][0] and (targets is None or i in targets)]
    out = raw
    for at in sorted((a for i in chosen for a in edits[i]), reverse=True):
        out = out[:at] + new.encode() + out[at + len(old) :]
    return out, chosen, left


def replace_ids(raw: bytes, links: dict[str, str]) -> bytes:
    """``raw`` with building ids replaced all at once; each must stand once, and no id may result twice."""
    members = scan(raw)
    ids = [m.gml_id for m in members]
    missing = [i for i in links if ids.count(i) != 1]
    after = [links.get(i, i) for i in ids]
    if missing or len(set(after)) != len(after):
        raise ValueError("ids must stand once before and after")
    out = raw
    for m in sorted(members, key=lambda m: -m.start):
        if m.gml_id in links:
            piece = out[m.start : m.stop]
            token = f'"{m.gml_id}"'.encode()
            if piece.count(token) != 1:
                raise ValueError(f"{m.gml_id} stands more than once in its member")
            out = out[: m.start] + piece.replace(token, f'"{links[m.gml_id]}"'.encode()) + out[m.stop :]
    return out


def rebuild_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """(file, content) of every base file rebuilt towards the head file of the same name."""

    @F.pandas_udf("binary")
    def merged(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rebuild(bytes(x), bytes(y)) for x, y in zip(a, b)])

    both = base.select("file", F.col("content").alias("a")).join(head.select("file", F.col("content").alias("b")), "file")
    return both.select("file", merged("a", "b").alias("content"))
