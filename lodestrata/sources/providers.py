"""Provider documentation in Markdown to statements of facts: one parser for each kind of source.

captured: source_no (long, order of capture), source_id, body, retrieved_at. A parser gives mentions, dicts of a model's
stated attributes; what a source does not state is not in them. Mentions become rows of statements(), which facts.py reduces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import code_spans, iso_date, labelled, links, sections, tables, tokens, tristate
from ..operators.facts import SOURCE_RANKS, closed_access, current_events, lifecycle_value, merge_by_rank

# Kinds of sources by the name in their id, and modalities by category of the serverless list.
KINDS = {"models-index": "index", "deprecations": "deprecations", "gemini-3": "gemini_3", "embeddings": "embeddings", "serving-paths": "serving_paths", "text-models": "text", "vision-models": "vision", "tool-calling": "tool", "changelog": "changelog", "serverless-models": "serverless"}
CATEGORIES = {"chat": ("text", "text"), "vision": ("text,image", "text"), "image": (None, "image"), "video": (None, "video"), "embedding": ("text", None), "moderation": ("text", None)}

MODEL_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:@-]*(?:/[A-Za-z0-9][A-Za-z0-9._-]*)*")
SERVING_ID = re.compile(r"accounts/[a-z0-9-]+/(?:models|routers)/[A-Za-z0-9._-]+|fireworks/[A-Za-z0-9._-]+")
EXAMPLE = re.compile(r"""["']?\bmodel["']?\s*[=:]\s*["']([^"'\s]+)["']""", re.IGNORECASE)
ALIAS = re.compile(r"`([^`]+)` (?:alias routes requests to|is an? (?:[a-z]+ )?alias (?:for|that resolves to)(?: the [a-z ]+)?) `([^`]+)`")
DATE = r"(?:\d{4}-\d{2}-\d{2}|[A-Z][a-z]+\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4})"


def kind_of(source_id: str) -> tuple[str, str] | None:
    """(provider, source type) of a source id such as openai-docs-deprecations or google-docs-model-page:slug; null if unknown."""
    m = re.fullmatch(r"([a-z]+)-docs-([a-z0-9-]+?)(:[^:\s]+)?", source_id or "")
    if not m or m[1] not in SOURCE_RANKS:
        return None
    kind = "model_page" if m[2] == "model-page" and m[3] else KINDS.get(m[2]) if not m[3] else None
    return (m[1], kind) if kind in SOURCE_RANKS[m[1]] else None


def plain(text: str) -> str:
    """Text without footnotes, links, bold and code marks."""
    text = re.sub(r"\^.*?\^(?=\W|$)|\^\{[^}]*\}", "", text)
    return re.sub(r"\s+", " ", re.sub(r"\[([^\]]*)\]\([^)\s]*\)", r"\1", text).replace("*", "").replace("`", "")).strip()


def cell(row: dict[str, str], *names: str) -> str:
    """The cell under the first of the headers that the row has; empty if none."""
    own = {plain(k).lower(): v for k, v in row.items()}
    return next((own[n] for n in names if n in own), "")


def ids(text: str) -> list[str]:
    """Model ids of a cell: its code spans, else its words between commas, bars and 'or'. Paths of endpoints are none."""
    spans = code_spans(text) or re.split(r"\\\||,|\bor\b|\band\b", plain(text))
    return list(dict.fromkeys(s.strip() for s in spans if MODEL_ID.fullmatch(s.strip())))


def modalities(text: str) -> str | None:
    found = re.findall(r"\b(text|image|audio|video|pdf)s?\b", re.sub(r"\([^)]*\)", "", text).lower())
    return ",".join(dict.fromkeys(found)) or None


def placed(body: str) -> Iterator[tuple[str, str, str]]:
    """(heading of the last section of level 1 or 2, own heading, text) of each section."""
    top = ""
    for level, heading, text in sections(unquoted(body)):
        if level <= 2:
            top = heading
        yield top, heading, text


def unquoted(body: str) -> str:
    """The body with tabs in block quotes as sections of their own."""
    lines = []
    for line in body.split("\n"):
        tab = re.match(r">\s*\[tab\]\s*(.+)", line)
        lines.append(f"### {tab[1]}" if tab else re.sub(r"^>\s?(?!\[!)", "", line))
    return "\n".join(lines)


def aliases(text: str) -> list[dict]:
    return [{"model": a, "resolves_to": b} for a, b in dict.fromkeys(ALIAS.findall(text)) if a != b]


def title(body: str) -> str | None:
    m = re.search(r"(?m)^# (.+?)\s*$", body)
    return plain(m[1]) if m else None


def replacements(cells: str, own: str) -> str | None:
    return ",".join(x for x in ids(cells) if x != own) or None


# --- OpenAI


def openai_index(body):
    for name, target in links(body):
        if m := re.search(r"/models/([a-z0-9][a-z0-9.-]*?)(?:\.md)?$", target):
            yield {"model": m[1], "display_name": plain(name), "listed": "true"}


def openai_deprecations(body):
    for top, heading, text in placed(body):
        listing = next((x for x in ("upcoming", "past") if x in top.lower()), None)
        for row in (r for t in tables(text) for r in t):
            what = cell(row, "model / system", "model", "deprecated model")
            found = ids(what)
            several = "\\|" in what
            for k, model in enumerate(found[:1] if several else found):
                yield {"model": model, "lifecycle": "deprecated", "deprecated_at": iso_date(heading.split(":")[0]), "retirement_at": iso_date(cell(row, "shutdown date", "retirement date")), "replacement": replacements(cell(row, "recommended replacement"), model), "aliases": ",".join(found[1:]) or None if several else None, "listing": listing, "event": True}


def openai_page(body):
    model = next(iter(ids(labelled(body, "Model ID") or "")), None)
    if not model:
        return
    own = {"model": model, "display_name": title(body)}
    intro = True
    for top, heading, text in placed(body):
        name = heading.lower()
        intro = intro and not (top and top != heading) and name not in ("model details", "pricing", "endpoints", "supported features")
        if intro or name in ("snapshots", "aliases"):
            yield from aliases(text)
            if m := re.search(r"\bin the ([A-Z][\w.-]*(?: [\w.-]+)?) family", text):
                own.setdefault("family", m[1])
            if re.search(r"(?mi)^>?\s*deprecated\b", text):
                own["lifecycle"] = "deprecated"
        elif name == "model details":
            for label, fact in (("Input modalities", "input_modalities"), ("Output modalities", "output_modalities")):
                own[fact] = modalities(labelled(text, label) or "")
            for pattern, fact in ((r"([\d,.]+[KM]?) context window", "context_window"), (r"([\d,.]+[KM]?) max output tokens", "max_output"), (r"(?i)maximum input tokens:\s*([\d,.]+[KM]?)", "max_input")):
                if m := re.search(pattern, text):
                    own[fact] = tokens(m[1])
        elif name == "endpoints":
            said = [tristate(cell(r, "support")) for t in tables(text) for r in t]
            if said:
                own["api_access"] = "true" if True in said else "false" if all(x is False for x in said) else None
        elif name == "supported features":
            own |= {fact: "true" for word, fact in (("function_calling", "tool_calling"), ("structured_outputs", "structured_output")) if re.search(rf"(?m)^\s*[-*]\s*`?{word}`?\s*$", text)}
    yield own


# --- Anthropic


def anthropic_index(body):
    for _, heading, text in placed(body):
        if heading.lower() != "compare models":
            continue
        line = next((s for s in re.split(r"(?<=\.)\s", text) if re.search(r"(?i)all current models support", s)), "")
        said = {}
        if m := re.search(r"support (.*?) input, (.*?) output", line):
            said = {"input_modalities": modalities(m[1]), "output_modalities": modalities(m[2])}
        if re.search(r"\btool use\b", line):
            said["tool_calling"] = "true"
        for table in tables(text):
            names = list(table[0])
            rows = {plain(r[names[0]]).lower(): r for r in table}
            for column in names[1:]:
                at = lambda key: rows.get(key, {}).get(column, "")  # noqa: E731, B023
                for model in ids(at("claude api id"))[:1]:
                    yield {"model": model, "display_name": plain(column), "family": family(column), "listed": "true", "context_window": tokens(at("context window")), "max_output": tokens(at("max output")), **said}
                    yield from ({"model": a, "resolves_to": model} for a in ids(at("claude api alias")) if a != model)


def family(name: str) -> str | None:
    m = re.match(r"Claude ([A-Z][a-z]+)", plain(name))
    return m[1] if m else None


def anthropic_deprecations(body):
    now, history = [], []
    for top, heading, text in placed(body):
        for row in (r for t in tables(text) for r in t):
            if state := cell(row, "current state"):
                state = plain(state).lower().split(" ")[0]
                if state in ("active", "legacy", "deprecated", "retired"):
                    now += [(m, state, iso_date(cell(row, "deprecated")), iso_date(cell(row, "tentative retirement date", "retirement date"))) for m in ids(cell(row, "api model name"))]
            elif "history" in top.lower():
                when = iso_date(cell(row, "retirement date"))
                history += [(m, when, iso_date(heading.split(":")[0]), replacements(cell(row, "recommended replacement"), m)) for m in ids(cell(row, "deprecated model"))]
    dates = {(m, r) for m, _, _, r in now}
    for model, state, since, gone in now:
        folded = next((r for m, when, _, r in history if (m, when) == (model, gone) and gone), None)
        yield {"model": model, "lifecycle": state, "deprecated_at": since, "retirement_at": gone, "replacement": folded, "api_access": "false" if state == "retired" else None, "listing": "current", "event": True}
    for model, when, since, other in history:
        if (model, when) not in dates:
            yield {"model": model, "lifecycle": "retired", "deprecated_at": since, "retirement_at": when, "replacement": other, "api_access": "false", "listing": "past", "event": True}


def anthropic_page(body):
    model = next(iter(ids(labelled(body, "Model ID") or "")), None)
    if not model:
        return
    own = {"model": model, "display_name": title(body), "family": family(title(body) or "")}
    for row in (r for _, _, text in placed(body) for t in tables(text) for r in t):
        what, value = plain(cell(row, "feature", "platform")).lower(), cell(row, "value", "model id")
        if what == "context window" or what == "max output":
            own["max_output" if what == "max output" else "context_window"] = tokens(value)
        elif what.startswith("input") and (sides := re.split(r"→|->", value))[1:]:
            own |= {"input_modalities": modalities(sides[0]), "output_modalities": modalities(sides[1])}
        elif what in ("tool use", "structured output", "structured outputs") and (said := tristate(plain(value))) is not None:
            own["tool_calling" if what == "tool use" else "structured_output"] = str(said).lower()
        elif what == "status" and (word := plain(value).lower().split(" ")[0]) in ("active", "legacy", "deprecated", "retired"):
            own["lifecycle"] = word
        elif what == "retirement":
            own["retirement_at"] = iso_date(value)
        elif what == "platforms":
            own["api_access"] = str("claude api" in plain(value).lower()).lower()
        elif what == "claude api alias":
            yield from ({"model": a, "resolves_to": model} for a in ids(value) if a != model)
    yield from ({"model": a, "resolves_to": b} for a, b in re.findall(r"`([^`]+)` is a convenience alias that resolves to [^`\n]*`([^`]+)`", body) if a != b)
    yield own


# --- Google


def google_index(body):
    for top, _, text in placed(body):
        previous = "previous" in top.lower()
        for row in (r for t in tables(text) for r in t):
            name = plain(cell(row, "model"))
            state = "retired" if "(shut down)" in name.lower() else "deprecated" if "(deprecated)" in name.lower() else None
            api = "false" if state == "retired" else None if previous else "true"
            for model in ids(cell(row, "endpoint")):
                yield {"model": model, "display_name": re.sub(r"\s*\((?:shut down|deprecated)\)", "", name, flags=re.IGNORECASE), "lifecycle": state, "api_access": api, "listed": None if previous or state else "true"}


def google_gemini_3(body):
    for row in (r for _, _, text in placed(body) for t in tables(text) for r in t):
        sides = cell(row, "context window (in / out)").split("/")
        for model in ids(plain(cell(row, "model id"))) if len(sides) == 2 else []:
            yield {"model": model, "max_input": tokens(sides[0]), "max_output": tokens(sides[1])}


def google_deprecations(body):
    for top, _, text in placed(body):
        listing = next((x for x in ("upcoming", "current", "past") if re.search(rf"(?i)\b{x}\b", top)), None)
        for row in (r for t in tables(text) for r in t):
            for model in code_spans(cell(row, "model"))[:1]:
                yield {"model": model, "replacement": ",".join(x for x in code_spans(cell(row, "recommended replacement")) if x != model) or None, "listing": listing, "event": True}


def google_page(body):
    rows = {plain(cell(r, "property")).lower(): cell(r, "description") for _, _, text in placed(body) for t in tables(text) for r in t if cell(r, "property")}
    model = next(iter(code_spans(rows.get("model code", ""))), None)
    if not model:
        return
    own = {"model": model, "display_name": title(body), "api_access": "true"}
    # **Input** Text **Output** Video: bold words name the parts of a cell
    parts = {k: {plain(a).lower().rstrip(":"): plain(b) for a, b in re.findall(r"\*\*(.+?)\*\*([^*]*(?:\*(?!\*)[^*]*)*)", v)} for k, v in rows.items()}
    types = parts.get("supported data types", {})
    own["input_modalities"] = modalities(types.get("inputs", types.get("input", "")))
    own["output_modalities"] = modalities(types.get("outputs", types.get("output", "")))
    for key in ("token limits", "limits"):
        for part, fact in (("input token limit", "max_input"), ("output token limit", "max_output"), ("context window", "context_window")):
            if part in parts.get(key, {}):
                own[fact] = tokens(parts[key][part])
        if m := re.match(r"(?i)context window:\s*(.+)", plain(rows.get(key, ""))):
            own["context_window"] = tokens(m[1])
    if "context window" in rows:
        own["context_window"] = tokens(plain(rows["context window"]))
    for part, fact in (("function calling", "tool_calling"), ("structured outputs", "structured_output")):
        if (said := tristate(parts.get("capabilities", {}).get(part, ""))) is not None:
            own[fact] = str(said).lower()
    shut = re.findall(r"(?i)shut down\*?\s*:\s*`([^`]+)`", rows.get("versions", ""))
    warning = " ".join(plain(x) for x in re.findall(r"(?m)^>\s?(.*)$", body) if "[!" not in x)
    if re.search(r"(?i)has been shut down|have been shut down", warning) or model in shut:
        own |= {"lifecycle": "retired", "api_access": "false"}
    elif re.search(r"(?i)\bdeprecated\b", warning):
        own["lifecycle"] = "deprecated"
    if m := re.search(rf"(?i:shut down)(?: on)? ({DATE})", warning):
        own["retirement_at"] = iso_date(m[1])
    yield own
    yield from aliases(body)
    yield from ({"model": x, "lifecycle": "retired", "api_access": "false"} for x in shut if x != model)


# --- Fireworks


def serving_ids(text: str) -> list[str]:
    """Serving ids in code spans; placeholders and deployments are none."""
    return list(dict.fromkeys(s for s in code_spans(text) if SERVING_ID.fullmatch(s)))


def examples(body: str) -> list[str]:
    return list(dict.fromkeys(x for x in EXAMPLE.findall(body) if SERVING_ID.fullmatch(x)))


_SERVERLESS = {"lifecycle": "active", "api_access": "true"}


def fireworks_embeddings(body):
    for _, _, text in placed(body):
        only = bool(re.search(r"(?i)\bserverless only\b", text))
        for row in (r for t in tables(text) for r in t):
            for model in ids(cell(row, "model id"))[:1]:
                if "/" in model and not re.search("deployments/|^accounts/your", model):
                    ready = only or bool(re.search(r"(?i)\bserverless\b", cell(row, "availability")))
                    yield {"model": model, "display_name": plain(cell(row, "model")) or None, "context_window": tokens(cell(row, "context")), "input_modalities": "text", **(_SERVERLESS if ready else {})}
        for sentence in re.split(r"\n\s*\n", text):
            if m := re.search(r"`([^`]+)`[^`]*no longer enabled", sentence):
                other = re.search(r"\bUse `([^`]+)`", sentence)
                yield {"model": m[1], "lifecycle": "retired", "api_access": "false", "replacement": other[1] if other and other[1] != m[1] else None}


def fireworks_serving_paths(body):
    named = [(i, plain(cell(r, "model"))) for _, _, text in placed(body) for t in tables(text) for r in t for i in serving_ids(cell(r, "model id"))]
    yield from ({"model": i, "display_name": name or None, **_SERVERLESS} for i, name in named)
    yield from ({"model": i, **_SERVERLESS} for i in examples(body) if i not in dict(named))


def fireworks_text(body):
    yield from ({"model": i, "input_modalities": "text", **_SERVERLESS} for i in examples(body))


def fireworks_vision(body):
    yield from ({"model": i, "input_modalities": "text,image", **_SERVERLESS} for i in examples(body))


def fireworks_tool(body):
    yield from ({"model": i, "tool_calling": "true", **_SERVERLESS} for i in examples(body))


def fireworks_page(body):
    yield from aliases(body)
    yield from ({"model": i, **_SERVERLESS} for i in examples(body))


# Wording of changelogs; the first that is found holds.
WORDING = (
    ("retired", r"no longer enabled|\b(?:is|are) no longer available\b|\b(?:is|are|was|were) (?:removed|retired)\b"),
    ("deprecated", r"no longer be available|scheduled for (?:removal|deprecation)|\bwill be (?:removed|retired|decommissioned)\b|decommissioned|deprecated from serverless|\b(?:is|are|has been|have been) deprecated\b"),
)


def wording(text: str) -> str | None:
    return next((state for state, pattern in WORDING if re.search(pattern, text, re.IGNORECASE)), None)


def fireworks_changelog(body):
    """Each paragraph or bullet with a lifecycle wording is an event of the serving ids before its guidance; the next
    paragraph's guidance counts if one model is meant. Wording about fine-tuning, on-demand or dedicated use alone is scoped."""
    for top, _, text in placed(body):
        listing = next((x for x in ("upcoming", "current", "past") if x in top.lower()), None)
        units = [u for p in re.split(r"\n\s*\n", text) for u in re.split(r"(?m)^(?=[-*] )", p) if u.strip()]
        for k, unit in enumerate(units):
            state = wording(unit)
            if not state:
                continue
            guide = re.search(r"(?i)\bmigrate to\b|\buse `|recommended replacement", unit)
            head, tail = (unit[: guide.start()], unit[guide.start() :]) if guide else (unit, "")
            found = serving_ids(head)
            if not tail and len(found) == 1 and k + 1 < len(units) and not wording(units[k + 1]) and (m := re.search(r"(?i)\bmigrate to\b.*", units[k + 1], re.DOTALL)):
                tail = m[0]
            when = re.search(DATE, unit)
            scoped = bool(re.search(r"(?i)\b(?:fine-tuning|on-demand|dedicated)\b", head)) and "serverless" not in head.lower()
            for model in found:
                yield {"model": model, "lifecycle": state, "retirement_at": iso_date(when[0]) if when else None, "replacement": ",".join(x for x in serving_ids(tail) if x != model) or None, "listing": listing, "event": True, "scoped": scoped}


# --- Together


def together_serverless(body):
    seen: dict[str, dict] = {}
    for _, heading, text in placed(body):
        category = re.sub(r"\s*models?$", "", heading.lower())
        for row in (r for t in tables(text) for r in t):
            for model in [x for x in ids(cell(row, "api model string", "model string for api")) if "/" in x][:1]:
                into, out = CATEGORIES.get(category, (None, None))
                if category == "audio":
                    kind = cell(row, "modality").lower()
                    into, out = ("audio", "text") if re.search("speech-to-text|transcription", kind) else ("text", "audio") if "text-to-speech" in kind else (None, None)
                said = {"model": model, "display_name": plain(cell(row, "model name")) or None, "context_window": tokens(cell(row, "context length")), "input_modalities": into, "output_modalities": out, **_SERVERLESS}
                for name, fact in (("function calling", "tool_calling"), ("structured outputs", "structured_output")):
                    if (x := tristate(cell(row, name))) is not None:
                        said[fact] = str(x).lower()
                if model in seen:  # the same id in two categories: modalities add up, other cells are statements of their own
                    first = seen[model]
                    for fact in ("input_modalities", "output_modalities"):
                        both = [x for v in (first.get(fact), said.pop(fact)) if v for x in v.split(",")]
                        first[fact] = ",".join(dict.fromkeys(both)) or None
                    said["display_name"] = None
                    first.setdefault("more", []).append(said)
                else:
                    seen[model] = said
    for said in seen.values():
        more = said.pop("more", [])
        yield said
        yield from more


def together_deprecations(body):
    moved, events = {}, []
    for top, heading, text in placed(body):
        for row in (r for t in tables(text) for r in t):
            if target := cell(row, "redirects to"):
                moved |= {m: target for m in ids(cell(row, "original model")) if "/" in m}
            elif gone := iso_date(cell(row, "removal date")):
                past = "history" in f"{top} {heading}".lower()
                events += [(m, gone, cell(row, "recommended replacement"), past) for m in ids(cell(row, "model")) if "/" in m]
    for model, gone, other, past in events:
        new = replacements(other, model) or (replacements(moved[model], model) if model in moved else None)
        yield {"model": model, "lifecycle": "retired" if past else "deprecated", "retirement_at": gone, "replacement": new, "api_access": "false" if past else None, "listing": "past" if past else "upcoming", "event": True}
    known = {e[0] for e in events}
    yield from ({"model": m, "replacement": replacements(to, m)} for m, to in moved.items() if m not in known and replacements(to, m))


def together_changelog(body):
    """Bullets below a sentence with a lifecycle wording. The sentence's removal date counts if it is the only one that is
    said; lines of a date alone, which tell when an entry was written, are none."""
    for _, heading, text in placed(body):
        if "deprecation" not in heading.lower() and "removal" not in heading.lower():
            continue
        prose = "\n".join(x for x in text.split("\n") if not re.match(r"\s*[-*] ", x) and not re.fullmatch(rf"\W*{DATE}\W*", x))
        state = wording(prose)
        dates = {iso_date(d) for d in re.findall(rf"\b(?:on|after|by) ({DATE})", prose)}
        for bullet in re.findall(r"(?m)^\s*[-*] (.+)$", text) if state else []:
            head, _, tail = bullet.partition("Recommended replacement")
            for model in [x for x in code_spans(head) if "/" in x and MODEL_ID.fullmatch(x)]:
                yield {"model": model, "lifecycle": state, "retirement_at": next(iter(dates)) if len(dates) == 1 else None, "replacement": ",".join(x for x in code_spans(tail)[:1] if x != model) or None, "api_access": "false" if state == "retired" else None, "event": True}


def together_page(body):
    """The one id that prose names; else those of tables of model ids, outside of code fences."""
    body = re.sub(r"(?ms)^\s*```.*?^\s*```\s*$", "", body)
    m = re.search(r"(?i)\bmodel (?:id|string)(?: is|:\**)\s*`([^`\s]+/[^`\s]+)`", body)
    if not m:
        for row in (r for _, _, text in placed(body) for t in tables(text) for r in t):
            for model in [x for x in ids(cell(row, "model id", "api model string", "model string")) if "/" in x][:1]:
                yield {"model": model, "display_name": plain(cell(row, "model", "model name")) or None, "context_window": tokens(cell(row, "context length", "context window", "context")), **_SERVERLESS}
        return
    own = {"model": m[1], "api_access": "true"}
    size = r"([\d.,]+\s?[KM]?)"
    for pattern, fact in ((rf"(?i){size}[- ]tokens? context window", "context_window"), (rf"(?i)context length:\**\s*{size}", "context_window"), (rf"(?i)up to {size} input tokens", "max_input"), (rf"(?i)up to {size} output tokens", "max_output")):
        if fact not in own and (x := re.search(pattern, body)):
            own[fact] = tokens(x[1])
    yield own


PARSERS = {
    ("openai", "index"): openai_index, ("openai", "deprecations"): openai_deprecations, ("openai", "model_page"): openai_page,
    ("anthropic", "index"): anthropic_index, ("anthropic", "deprecations"): anthropic_deprecations, ("anthropic", "model_page"): anthropic_page,
    ("google", "index"): google_index, ("google", "gemini_3"): google_gemini_3, ("google", "deprecations"): google_deprecations, ("google", "model_page"): google_page,
    ("fireworks", "embeddings"): fireworks_embeddings, ("fireworks", "serving_paths"): fireworks_serving_paths, ("fireworks", "text"): fireworks_text, ("fireworks", "vision"): fireworks_vision,
    ("fireworks", "tool"): fireworks_tool, ("fireworks", "changelog"): fireworks_changelog, ("fireworks", "model_page"): fireworks_page,
    ("together", "serverless"): together_serverless, ("together", "deprecations"): together_deprecations, ("together", "changelog"): together_changelog, ("together", "model_page"): together_page,
}
TYPES = {"context_window": "int", "max_input": "int", "max_output": "int", "api_access": "bool", "tool_calling": "bool", "structured_output": "bool", "listed": "bool", "input_modalities": "list", "output_modalities": "list", "aliases": "list", "replacement": "list"}
NAMES = ("display_name", "resolves_to", "aliases", "family", "listed", "lifecycle", "deprecated_at", "retirement_at", "replacement", "context_window", "max_input", "max_output", "input_modalities", "output_modalities", "tool_calling", "structured_output", "api_access")
_SCHEMA = "seq long, provider string, model_id string, fact_name string, value string, value_type string, source_id string, source_type string, rank int, verified_at string, event long, listing string, scoped boolean"


def mentions(source_id: str, body: str) -> list[dict]:
    kind = kind_of(source_id)
    return list(PARSERS[kind](body or "")) if kind else []


def statements(captured: DataFrame) -> DataFrame:
    """One row per model, attribute and mention, in order of seq. Mentions of one event share its number.

    Sources whose id is unknown and bodies without anything to read give no rows; null bodies are empty. A first
    mention of a model without an attribute is a row with the fact 'listed' and no value, so that no model is lost.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for no, source, body, at in zip(*(batch.column(c).to_pylist() for c in ("source_no", "source_id", "body", "retrieved_at")), strict=True):
                for k, said in enumerate(mentions(source, body)):
                    provider, kind = kind_of(source)
                    seq = no * 1_000_000 + k * 20
                    facts = [(n, str(said[n])) for n in NAMES if said.get(n) is not None] or [("listed", None)]
                    event = seq if said.get("event") else None
                    rows += [(seq + j, provider, said["model"], n, v, TYPES.get(n, "str"), source, kind, SOURCE_RANKS[provider][kind], at, event, said.get("listing"), bool(said.get("scoped"))) for j, (n, v) in enumerate(facts)]
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[x.split()[1]]) for i, x in enumerate(_SCHEMA.split(", "))], names=names)

    source = captured.select(F.col("source_no").cast("long").alias("source_no"), "source_id", "body", F.col("retrieved_at").cast("string").alias("retrieved_at"))
    return source.mapInArrow(run, _SCHEMA)


def content_hashes(captured: DataFrame) -> DataFrame:
    """source_id, content_hash of each captured source."""
    return captured.select("source_id", F.concat(F.lit("sha256:"), F.sha2(F.col("body").cast("binary"), 256)).alias("content_hash"))


def contradictions(said: DataFrame) -> DataFrame:
    """Events that end before they were announced; a provider with any is not to be merged."""
    return _events(said).where("retires < announced")


def _events(said: DataFrame) -> DataFrame:
    pick = lambda n: F.max(F.when(F.col("fact_name") == n, F.col("value")))
    return said.where("event IS NOT NULL AND NOT scoped").groupBy("provider", "model_id", F.col("event").alias("seq")).agg(F.max("listing").alias("listing"), pick("deprecated_at").alias("announced"), pick("retirement_at").alias("retires"), pick("replacement").alias("replacements"))


def reduce_statements(said: DataFrame) -> DataFrame:
    """Facts of every model: provider, model_id, fact_name, status, value, source_id, verified_at, claims.

    Statements of events that are not a model's current ones, and of scoped events, do not count; nor do past events of
    models on together's serverless list. For google any source that says retired is believed. Then the highest
    rank decides, the lifecycle follows the calendar (where only deprecated rows of openai become retired), models
    that an index lists and no source states a lifecycle of are active, and retired models have no access.
    """
    own = said.where("NOT scoped")
    offered = own.where("source_type = 'serverless'").select("provider", "model_id").distinct()
    stale = own.where("provider = 'together' AND listing = 'past'").join(offered, ["provider", "model_id"], "left_semi").select("event").distinct()
    own = own.join(stale, "event", "left_anti")
    said = own
    retired = F.expr("provider = 'google' AND fact_name = 'lifecycle' AND value = 'retired'")
    own = own.withColumn("rank", F.when(retired, F.lit(9)).otherwise(F.col("rank")))
    key = F.concat_ws("\x1f", "provider", "model_id")
    now = current_events(_events(said).withColumn("model_id", key)).select(F.col("seq").alias("event"))
    live = own.where("event IS NULL").unionByName(own.join(now, "event", "left_semi"))
    merged = merge_by_rank(live)
    dates = merged.where("fact_name = 'retirement_at' AND status = 'known'").select("provider", "model_id", F.col("value").alias("retires"))
    facts = merged.where("fact_name <> 'listed'").join(dates, ["provider", "model_id"], "left")
    may = (F.col("fact_name") == "lifecycle") & (F.col("status") == "known") & ((F.col("provider") != "openai") | (F.col("value") == "deprecated"))
    facts = facts.withColumn("value", F.when(may, lifecycle_value(F.col("value"), F.col("retires"), F.col("verified_at"))).otherwise(F.col("value"))).drop("retires")
    listed = merged.where("fact_name = 'listed' AND value = 'true'").join(facts.where("fact_name = 'lifecycle'").select("provider", "model_id"), ["provider", "model_id"], "left_anti")
    active = listed.withColumn("fact_name", F.lit("lifecycle")).withColumn("value", F.lit("active")).select(*facts.columns)
    return closed_access(facts.union(active))


def dispositions(said: DataFrame) -> DataFrame:
    """provider, model_id, disposition: historical_reference_only for models of fireworks that only its changelog names."""
    only = F.bool_and((F.col("provider") == "fireworks") & (F.col("source_type") == "changelog"))
    return said.groupBy("provider", "model_id").agg(F.when(only, "historical_reference_only").otherwise("currently_documented").alias("disposition"))
