"""Extraction from Java sources: one file's text to entity and edge rows.

The text is masked twice, offsets kept: once without comments, once without comments and literals. One pass over the
braces of the bare text builds the tree of type bodies; members are read from what stands directly in a type body. What an
annotation means is looked up by the first declaration after it.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from weft.operators.rows import FACT, INFERRED, FileRows

# Annotations, interfaces, and verbs that are looked for, each replaceable by the configuration.
ENDPOINT_ANNOTATIONS = ("RmbMap", "DubboService", "RpcMapping")
ENDPOINT_INTERFACES = ("ApiHandler", "IBizProcess")
ENTRY_METHODS = ("handle", "handleRequest", "bizProcess", "process", "apiProcess")
SCHEDULERS = ("Scheduled", "XxlJob", "JobHandler")
ANNOTATIONS = (
    "Transactional", "Async", "Cacheable", "CacheEvict", "CachePut", "EventListener", "PostConstruct", "PreDestroy", "TransactionalEventListener", "Aspect",
    "Entity", "Table", "Mapper", "Repository", "ConditionalOnProperty", "Profile",
)
NO_ANNOTATIONS = ("Override", "SuppressWarnings", "Deprecated", "Generated")
WRAPPER_VERBS = "eq|ne|gt|ge|lt|le|like|notLike|in|notIn|between|orderBy(?:Asc|Desc)?|groupBy|having|select"

LITERALS = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?', re.S)
TYPE = re.compile(r"\b(class|interface)\s+([A-Za-z_]\w*)")
BODY_OWNER = re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_]\w*)")
FIELD = re.compile(r"\b(?:private|protected|public)\s+[\w<>,.?]+\s+([A-Za-z_]\w*)\s*;")
CALL_LIKE = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")
ANNOTATION = re.compile(r"@([A-Za-z_]\w*)")
STRING = re.compile(r'"([^"]*)"')
NAMED_PATH = re.compile(r'(?:value|path)\s*=\s*\{?\s*"([^"]*)"')
MEMBER_FIELD = re.compile(r"((?:@\w+\s*(?:\([^)]*\))?\s*)*)((?:(?:private|protected|public|static|final|transient|volatile)\s+)*)([A-Za-z_][\w.]*(?:\s*<[^;={}]*>)?(?:\[\])*)\s+([A-Za-z_]\w*)\s*(=[^;]*)?;")
#: Annotations and modifiers right before a name: what is left before them tells a method from a constructor.
LEADING = re.compile(r"(?:\s*(?:@\w+(?:\s*\([^()]*\))?|\b(?:public|protected|private|static|final|abstract)\b))+\s*$")
KEYWORDS = frozenset("if for while switch catch synchronized return new throw else do try assert super this case instanceof".split())
WRAPPER_TEXT = re.compile(rf'\.(?:{WRAPPER_VERBS})\s*\(\s*"([A-Za-z_]\w*)"')
WRAPPER_GETTER = re.compile(rf"\.(?:{WRAPPER_VERBS})\s*\(\s*[A-Za-z_]\w*::([A-Za-z_]\w*)")
BASE_MAPPER = re.compile(r"\binterface\s+([A-Za-z_]\w*)\s*(?:extends|,)\s*BaseMapper(?:Plus)?\s*<\s*([A-Za-z_]\w*)")
EXECUTION = re.compile(r"execution\s*\(\s*\S+\s+([\w.$]+)\s*\(")
PATH_VARIABLE = re.compile(r"\{[^}]+\}|\$\{[^}]+\}|\b\d+\b")


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def masks(text: str) -> tuple[str, str]:
    """(without comments, without comments and literals), both as long as the text."""
    is_comment = lambda s: s.startswith(("//", "/*"))
    code = LITERALS.sub(lambda m: blank(m[0]) if is_comment(m[0]) else m[0], text)
    return code, LITERALS.sub(lambda m: blank(m[0]), text)


def normalized(path: str) -> str:
    return re.sub("/{2,}", "/", "/" + PATH_VARIABLE.sub("{}", path).strip("/"))


def snake(name: str) -> str:
    return re.sub("([a-z])([A-Z])", r"\1_\2", re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", name)).lower()


def property_of(getter: str) -> str:
    bare = re.sub("^(?:get|is)(?=.)", "", getter)
    return bare[:1].lower() + bare[1:]


def closing(text: str, at: int, pair: str = "()") -> int:
    """Offset after the bracket that closes the one at ``at``; the text's end if none does."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(text)


def top_level(text: str, separator: str = ",") -> list[str]:
    """The parts between separators that stand in no bracket."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "(<[{") - (c in ")>]}")
        if c == separator and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def annotation_path(arguments: str) -> str | None:
    """value= or path= first, else the first literal."""
    found = NAMED_PATH.search(arguments) or STRING.search(arguments)
    return found[1] if found else None


@dataclass
class Type:
    kind: str
    name: str
    at: int
    start: int
    end: int
    header: str
    inner: list[Type] = field(default_factory=list)


@dataclass
class Method:
    name: str
    at: int
    arity: int
    owner: Type
    end: int
    body: tuple[int, int] | None
    parameters: str
    constructor: bool
    id: str = ""


class Source:
    def __init__(self, text: str):
        self.text = text
        self.code, self.bare = masks(text)
        self.types, self.broken = self._types()
        self.methods = self._methods()

    def _types(self) -> tuple[list[Type], bool]:
        out, stack, last, broken = [], [], 0, False
        for m in re.finditer(r"[{};]", self.bare):
            if m[0] == "{":
                header = self.bare[last : m.start()]
                owner = list(BODY_OWNER.finditer(header))
                found = Type(owner[0][1], owner[0][2], last + owner[0].start(2), m.end(), len(self.bare), header) if owner else None
                stack.append(found)
                if found:
                    out.append(found)
            elif m[0] == "}":
                if stack:
                    if (closed := stack.pop()) is not None:
                        closed.end = m.start()
                else:
                    broken = True
            last = m.end()
        return out, broken or bool(stack)

    def owner_of(self, at: int) -> Type | None:
        """The innermost type whose body holds the offset."""
        inside = [t for t in self.types if t.start <= at < t.end]
        return max(inside, key=lambda t: t.start, default=None)

    def direct(self, t: Type) -> str:
        """The type's body with everything in deeper braces blanked, padded to its place."""
        out, depth = [], 0
        for c in self.bare[t.start : t.end]:
            depth -= c == "}"
            out.append(c if depth == 0 or c == "\n" else " ")
            depth += c == "{"
        return "".join(out)

    def _methods(self) -> list[Method]:
        out = []
        for t in self.types:
            body = self.direct(t)
            for m in CALL_LIKE.finditer(body):
                name, at = m[1], t.start + m.start(1)
                before = LEADING.sub("", body[max(0, m.start(1) - 2000) : m.start(1)].rstrip())
                word = re.search(r"[\w$]+$", before)
                if name in KEYWORDS or before.endswith((".", "@", "=", "(", ",")) or (word and word[0] in ("new", "return")):
                    continue
                end = closing(self.bare, t.start + m.end() - 1)
                after = re.match(r"\s*(?:\[\]\s*)*(?:throws\s+[\w.,\s]+?)?\s*(default\b[^;]*)?([{;])", self.bare[end : end + 2000])
                typed = re.search(r"[\w>\]]$", before)
                constructor = name == t.name and not typed
                if not after or not (typed or constructor):
                    continue
                parameters = self.bare[t.start + m.end() : end - 1]
                span = None
                stop = end + after.end()
                if after[2] == "{":
                    stop = closing(self.bare, end + after.end() - 1, "{}")
                    span = (end + after.end(), stop - 1)
                out.append(Method(name, at, len(top_level(parameters)), t, stop, span, parameters, constructor))
        return sorted(out, key=lambda x: x.at)

    def annotations(self, names: str, text: str | None = None):
        """(name, arguments, offset, end) of the annotations; arguments as in the code, whatever brackets their strings hold."""
        for m in re.finditer(rf"@({names})\b", text or self.bare):
            open_at = re.compile(r"\s*\(").match(self.bare, m.end())
            end = closing(self.bare, open_at.end() - 1) if open_at else m.end()
            yield m[1], self.code[open_at.end() : end - 1] if open_at else "", m.start(), end


def receiver(bare: str, at: int) -> tuple[str, str | None]:
    """What a call at ``at`` is called on: its class and, if it has one, its name."""
    before = bare[:at].rstrip()
    if not before.endswith("."):
        return ("new", None) if re.search(r"\bnew$", before) else ("bare", None)
    before = before[:-1].rstrip()
    if before.endswith(")"):
        return "chain", None
    path = re.search(r"[\w$]+(?:\s*\.\s*[\w$]+)*$", before)
    parts = re.split(r"\s*\.\s*", path[0]) if path else []
    if not parts:
        return "chain", None
    if parts in (["this"], ["super"]):
        return parts[0], None
    if parts[0] == "this" and len(parts) == 2:
        return "field", parts[1]
    return ("name", parts[0]) if len(parts) == 1 else ("qualified", parts[-1])


def extract(path: str, text: str, file_hash: str, config: dict | None = None) -> FileRows:
    config = config or {}
    source, rows = Source(text), FileRows(path, text, file_hash)
    sure = 0.8 if source.broken else 1.0
    declared = [(m.start(2), m[1], m[2]) for m in TYPE.finditer(source.bare)]
    injected: dict[str, list[tuple[str, str]]] = {t.name: [] for t in source.types}
    ids: dict[int, str] = {}
    owners: list[tuple[int, str]] = []

    # injection: annotated fields, generated constructors, the annotated or the only constructor
    for t in source.types:
        body = source.direct(t)
        members = [(m, m[1], m[2].split(), re.sub(r"\s*<.*", "", m[3], flags=re.S).split(".")[-1]) for m in MEMBER_FIELD.finditer(body)]
        generated = {a for a in ("RequiredArgsConstructor", "AllArgsConstructor") if f"@{a}" in t.header}
        beans: list[tuple[str | None, str, int]] = []
        for m, marks, modifiers, kind in members:
            wanted = re.search(r"@(?:Autowired|Resource)\b", marks) or ("static" not in modifiers and not m[5] and ("AllArgsConstructor" in generated or ("RequiredArgsConstructor" in generated and "final" in modifiers)))
            if wanted:
                beans.append((m[4], kind, t.start + m.start(4)))
        constructors = [m for m in source.methods if m.owner is t and m.constructor]
        chosen = [m for m in constructors if re.search(r"@Autowired\s*(?:\([^)]*\))?\s*(?:\w+\s+)*$", source.bare[t.start : m.at])] or (constructors if len(constructors) == 1 else [])
        for m in chosen:
            for p in top_level(m.parameters):
                parts = re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b|<.*>", " ", p, flags=re.S).split()
                if len(parts) >= 2:
                    beans.append((parts[-1], parts[-2].split(".")[-1], m.at))
        for name, kind, at in beans:
            injected[t.name].append((name, kind))
            bean = rows.entity("spring_bean", kind, kind, at, contained=True, reason="injected type")
            rows.edge(rows.id_of(t.kind if t.kind in ("class", "interface") else "class", t.name), bean, "injects", at, reason="dependency injection")

    for at, kind, name in declared:
        t = next((x for x in source.types if x.at == at), None)
        header = t.header if t else ""
        meta: dict = {}
        plain = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", header))
        if kind == "class":
            if m := re.search(r"\bimplements\s+([\w.,\s]+)$", plain):
                meta["implements"] = [x for x in top_level(m[1]) if re.fullmatch(r"[A-Za-z_][\w.]*", x)]
            if m := re.search(rf"\bclass\s+{name}\b[^{{]*?\bextends\s+([A-Za-z_]\w*)", plain):
                meta["superclass"] = m[1]
            if re.search(rf"\babstract\s+class\s+{name}\b", header):
                meta["abstract"] = True
        if t and re.search(r"@Transactional\b", header + source.direct(t)):
            meta["transactional"] = True
        if t and re.search(r"@Scheduled\b", source.direct(t)):
            meta["scheduled"] = True
        if injected.get(name):
            meta["injected_fields"] = [{"name": f, "type": k} for f, k in injected[name]]
        ids[at] = rows.entity(kind, name, name, at, meta=meta, confidence=sure, contained=True, reason="type declaration")
        owners.append((at, ids[at]))

    class_starts = [at for at, _, _ in declared]
    for m in FIELD.finditer(source.bare):
        i = bisect.bisect_right(class_starts, m.start(1)) - 1
        owner = declared[i][2] if i >= 0 else None
        qualified = f"{owner}.{m[1]}" if owner else m[1]
        rows.entity("field", m[1], f"{path}#{qualified}", m.start(1), discriminator=owner or "", confidence=sure, contained=True, reason="field declaration")

    for m in source.methods:
        if m.constructor:
            continue
        invokes = []
        if m.body:
            inner = [x for x in source.methods if x is not m and m.body[0] <= x.at < m.body[1]]
            for call in CALL_LIKE.finditer(source.bare, *m.body):
                kind, name = receiver(source.bare, call.start(1))
                if call[1] in KEYWORDS or kind == "new" or any(x.at == call.start(1) or (x.body and x.body[0] <= call.start() < x.body[1]) for x in inner):
                    continue
                invokes.append({"name": call[1], "line": rows.line(call.start(1)), "receiver_kind": kind, "receiver": name})
        meta = {"body_end_line": rows.line(m.end - 1), "arity": m.arity} | ({"invokes": invokes} if invokes else {})
        m.id = rows.entity("method", m.name, f"{path}#{m.name}", m.at, discriminator=f"arity:{m.arity}", meta=meta, contained=True, reason="method declaration")
        kind = m.owner.kind if m.owner.kind in ("class", "interface") else "class"
        rows.edge(rows.id_of(kind, m.owner.name), m.id, "declares", m.at, reason="method declared by type")
        owners.append((m.at, m.id))
    owners.sort()
    methods = [m for m in source.methods if m.id]
    method_starts = [m.at for m in methods]

    def next_method(at: int) -> Method | None:
        i = bisect.bisect_right(method_starts, at)
        return methods[i] if i < len(methods) else None

    def next_owner(at: int) -> str | None:
        i = bisect.bisect_right(owners, (at, chr(0x10FFFF)))
        return owners[i][1] if i < len(owners) else None

    def next_type(at: int) -> int | None:
        i = bisect.bisect_right(class_starts, at)
        return class_starts[i] if i < len(class_starts) else None

    # calls inside the file, where both names are unique in it
    by_name: dict[str, list[Method]] = {}
    for m in methods:
        by_name.setdefault(m.name, []).append(m)
    for m in methods:
        for call in rows.meta(m.id).get("invokes", ()):
            target = by_name.get(call["name"], ())
            if len(by_name[m.name]) == 1 and len(target) == 1 and target[0] is not m:
                rows.edge(m.id, target[0].id, "calls", m.at, INFERRED, 0.7, "same-file call", line=call["line"])

    # web endpoints
    base, mappings = "", list(source.annotations("GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping"))
    on_types = set()
    for name, arguments, at, end in mappings:
        t, m = next_type(end), next_method(end)
        if name == "RequestMapping" and t is not None and (m is None or t < m.at):
            on_types.add(at)
            base = base or annotation_path(arguments) or ""
    for name, arguments, at, end in mappings:
        found = annotation_path(arguments)
        if at in on_types or found is None:
            continue
        verb = None if name == "RequestMapping" else name.removesuffix("Mapping").upper()
        full = normalized(f"{base}/{found}")
        label = f"{verb or 'ANY'} {full}"
        endpoint = rows.entity("http_endpoint", label, label, at, meta={"path": full} | ({"method": verb} if verb else {}), contained=True, reason="request mapping")
        if m := next_method(end):
            rows.edge(m.id, endpoint, "exposes", at, reason="handler of the mapping")
    names = "|".join(map(re.escape, config.get("endpoint_annotations", ENDPOINT_ANNOTATIONS)))
    for name, arguments, at, _ in source.annotations(names) if names else ():
        value = annotation_path(arguments)
        rows.entity("http_endpoint", value or name, value or name, at, discriminator="" if value else str(rows.line(at)), meta={"path": value or name, "framework": name}, contained=True, reason="endpoint annotation")
    marked = set(config.get("endpoint_interfaces", ENDPOINT_INTERFACES))
    for at, kind, name in declared:
        for interface in (x for x in rows.meta(ids[at]).get("implements", ()) if x in marked):
            endpoint = rows.entity("http_endpoint", name, name, at, discriminator=f"iface:{interface}", meta={"path": name, "framework": f"implements {interface}"}, classification=INFERRED, confidence=0.8, contained=True, reason="endpoint interface")
            for m in methods:
                if m.owner.name == name and m.name in ENTRY_METHODS:
                    rows.edge(m.id, endpoint, "exposes", m.at, INFERRED, 0.8, "entry method")
    for _, _, at, end in source.annotations("Bean"):
        m = next_method(end)
        head = source.bare[end : m.at].split() if m else []
        if head:
            kind = re.sub("<.*", "", head[-1])
            bean = rows.entity("spring_bean", kind, kind, at, contained=True, reason="bean factory")
            if (owner := source.owner_of(at)) is not None:
                rows.edge(rows.id_of("class", owner.name), bean, "exposes", at, reason="bean factory")

    # tables and columns of mapped classes
    tables: dict[str, str] = {}
    for _, arguments, at, end in source.annotations("TableName"):
        value, t = annotation_path(arguments), next_type(end)
        if value is None:
            continue
        table = rows.entity("table", value, value, at, reason="mapped table")
        if t is not None:
            tables[next(n for a, _, n in declared if a == t)] = table
            rows.edge(ids[t], table, "depends_on", at, reason="class mapped to table")
    for t in source.types:
        if t.name not in tables:
            continue
        for m in FIELD.finditer(source.direct(t)):
            at = t.start + m.start(1)
            begin = max(source.bare.rfind(c, 0, t.start + m.start()) for c in ";{}") + 1
            marks = source.code[begin:at]
            if re.search(r"exist\s*=\s*false", marks):
                continue
            named = re.search(r'@Table(?:Field|Id)\s*\(([^)]*)\)', marks)
            value = annotation_path(named[1]) if named else None
            column = rows.entity("column", value or snake(m[1]), f"{path}#{value or snake(m[1])}", at, meta={"mapped_field": m[1], "source": "mybatis_plus"}, classification=FACT if value else INFERRED, confidence=1.0 if value else 0.7, reason="mapped column")
            rows.edge(rows.id_of("field", m[1], f"{path}#{t.name}.{m[1]}", t.name), column, "mapped_from", at, FACT if value else INFERRED, 1.0 if value else 0.7, "field mapped to column")
    for m in BASE_MAPPER.finditer(source.bare):
        mapper = rows.entity("mapper", m[1], m[1], m.start(1), meta={"entity_type": m[2]}, contained=True, reason="base mapper")
        if m[2] in tables:
            rows.edge(mapper, tables[m[2]], "depends_on", m.start(1), reason="mapper of the table's class")
    for pattern, origin, name_of in ((WRAPPER_TEXT, "query_wrapper", str), (WRAPPER_GETTER, "lambda_wrapper", lambda g: snake(property_of(g)))):
        for m in pattern.finditer(source.code):
            name = name_of(m[1])
            column = rows.entity("column", name, f"{path}#{name}", m.start(1), meta={"source": origin}, classification=INFERRED, confidence=0.6, reason="query wrapper")
            rows.edge(rows.file_id, column, "reads_column", m.start(1), INFERRED, 0.6, "query wrapper")

    # annotations, tests, jobs, advice
    allowed = set(config.get("annotations", ANNOTATIONS)) - set(config.get("no_annotations", NO_ANNOTATIONS))
    for m in ANNOTATION.finditer(source.bare):
        if m[1] in allowed and (owner := next_owner(m.start())):
            line = rows.line(m.start())
            found = rows.entity("annotation", m[1], f"{path}#{m[1]}@{line}", m.start(), discriminator=str(line), reason="annotation")
            rows.edge(owner, found, "annotated", m.start(), reason="annotated by")
    for m in re.finditer(r"@Test\b", source.bare):
        follower, line = next_method(m.end()), rows.line(m.start())
        name = follower.name if follower else "test"
        rows.entity("test_case", name, f"{path}#test:{name}:{line}", m.start(), discriminator=f"test:{line}", meta={"tested_method": name}, reason="test annotation")
    jobs = "|".join(map(re.escape, config.get("schedulers", SCHEDULERS)))
    for name, _, at, end in source.annotations(jobs) if jobs else ():
        if follower := next_method(end):
            line = rows.line(at)
            job = rows.entity("job", follower.name, f"{path}#job:{follower.name}:{line}", at, discriminator=f"sched:{line}", meta={"trigger": name}, reason="scheduler annotation")
            rows.edge(job, follower.id, "schedules", at, reason="scheduled method")
    for name, arguments, _, end in source.annotations("Around|Before|After|AfterReturning|AfterThrowing"):
        literal = annotation_path(arguments)
        cut = EXECUTION.search(literal or "")
        if cut and (follower := next_method(end)):
            rows.add_meta(follower.id, {"pointcut": cut[1], "aspect_advice": name})
    return rows
