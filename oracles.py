"""DuckDB SQL for the registered queries, written from the rules, not from the Spark code.

``VIEWS`` derives the message, link, host and score relations step by step; a
query adds its own final SELECT.  DuckDB computes only the relations it needs.
"""

from __future__ import annotations

import hashlib

import csv
from pathlib import Path

from msgrisk import fixed_values as fv
from msgrisk.plans import demo

REGISTRY = list(csv.DictReader((Path(__file__).parent / "msgrisk/data/registry.csv").open(newline="")))
VERIFIED = [r for r in REGISTRY if r["trust_type"] in ("primary", "email")]
BRANDS = list(dict.fromkeys(r["brand"] for r in VERIFIED))
FIRST_LABELS = list(dict.fromkeys(r["domain"].split(".")[0] for r in sorted(VERIFIED, key=lambda r: BRANDS.index(r["brand"]))))


def registry_aliases():
    """Every brand in lower case, with and without blanks."""
    for place, brand in enumerate(BRANDS):
        for alias in sorted({brand.lower(), brand.lower().replace(" ", "")}):
            yield alias, place, brand


def registry_labels():
    """First labels of three letters or more in the order of their brands; the last brand with it owns a label."""
    kept = [x for x in FIRST_LABELS if len(x) >= 3]
    for place, label in enumerate(kept):
        owners = [r["brand"] for r in sorted(VERIFIED, key=lambda r: BRANDS.index(r["brand"])) if r["domain"].split(".")[0] == label]
        yield label, place, owners[-1]


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)


def listing(items) -> str:
    return ", ".join(q(i) for i in items)


WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EMOJI = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in fv.EMOJI_RANGES)
DOMAIN_RE = r"(?i)\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def mask(x: str, cards: bool = True) -> str:
    x = rf"regexp_replace({x}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '[email]', 'g')"
    x = rf"regexp_replace({x}, '(^|[^0-9])(\+?[0-9][0-9{WS}().-]{{7,}}[0-9])', '\1[phone]', 'g')"
    if cards:
        x = rf"regexp_replace({x}, '\b(?:[0-9][ -]*?){{13,19}}\b', '[number]', 'g')"
    return rf"regexp_replace({x}, '\b[A-Za-z0-9_-]{{32,}}\b', '[token]', 'g')"


def category(x: str) -> str:
    local = f"lower(trim(regexp_extract({x}, '(?s)^(.*)@', 1)))"
    return (
        f"CASE WHEN NOT contains({x}, '@') THEN 'unknown' "
        f"WHEN regexp_full_match({local}, 'no-?reply|do-?not-?reply|donotreply') THEN 'noreply' "
        f"WHEN regexp_full_match({local}, 'notifications?|alerts?|updates?') THEN 'notification' "
        f"WHEN regexp_full_match({local}, 'support|help|service|customer-service|callsupport') THEN 'support' "
        "ELSE 'unknown' END"
    )


def phrases(text: str, items) -> str:
    return "(" + " + ".join(f"contains({text}, {q(i)})::INT" for i in items) + ")::DOUBLE"


def refang(x: str) -> str:
    x = rf"regexp_replace({x}, '(?i)\bhxxps://', 'https://', 'g')"
    x = rf"regexp_replace({x}, '(?i)\bhxxp://', 'http://', 'g')"
    return rf"regexp_replace({x}, '\[\s*\.\s*\]|\(\s*\.\s*\)|\{{\s*\.\s*\}}', '.', 'g')"


def schemed(x: str) -> str:
    return f"(CASE WHEN contains({x}, '://') THEN {x} ELSE 'https://' || {x} END)"


def host(x: str) -> str:
    return rf"trim(lower(trim(regexp_extract({schemed(x)}, '{SCHEME}(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '[]')), '.')"


def path(x: str) -> str:
    return (
        rf"regexp_replace(CASE WHEN regexp_matches({schemed(x)}, '{SCHEME}') "
        rf"THEN regexp_extract({schemed(x)}, '{SCHEME}[^/?#]*([^?#]*)', 1) "
        rf"ELSE regexp_extract({schemed(x)}, '^[^?#]*') END, ';[^/]*$', '')"
    )


def norm_domain(x: str) -> str:
    v = f"trim(lower({x}))"
    v = f"(CASE WHEN contains({v}, '://') THEN {host(v)} ELSE {v} END)"
    return (
        rf"trim(regexp_replace(CASE WHEN NOT contains({v}, '@') THEN {v} "
        rf"WHEN regexp_matches({v}, '@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') "
        rf"THEN regexp_extract({v}, '@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', 1) "
        rf"ELSE split_part({v}, '@', -1) END, '^www\.', ''), '.')"
    )


def labels(h: str) -> str:
    return f"list_filter(string_split({h}, '.'), lambda p: p <> '')"


def last_two(h: str) -> str:
    return f"(CASE WHEN len({labels(h)}) <= 2 THEN {h} ELSE array_to_string(({labels(h)})[-2:], '.') END)"


def entropy(x: str) -> str:
    chars = f"regexp_extract_all({x}, '(?s).')"
    share = f"((length({x}) - length(replace({x}, c, '')))::DOUBLE / length({x}))"
    return (
        f"(CASE WHEN length({x}) = 0 THEN 0.0 ELSE "
        f"coalesce(list_sum(list_transform(list_sort(list_distinct({chars})), lambda c: -{share} * log2({share}))), 0.0) END)"
    )


def ascii_only(x: str) -> str:
    return rf"regexp_replace({x}, '[^\x00-\x7F]', '~', 'g')"


def skeleton(x: str) -> str:
    for looks, like in fv.CONFUSABLES.items():
        x = f"replace({x}, {q(looks)}, {q(like)})"
    return f"lower({x})"


def random_score(label: str) -> str:
    p = f"regexp_replace(lower({label}), '[^a-z0-9]', '', 'g')"

    def share(cls: str) -> str:
        return f"length(regexp_replace({p}, '[^{cls}]', '', 'g'))::DOUBLE / length({p})"

    return (
        f"(CASE WHEN length({p}) < 7 THEN 0.0 ELSE round(least("
        f"(CASE WHEN {entropy(p)} >= 2.75 THEN 0.45 ELSE 0 END)::DOUBLE"
        f" + (CASE WHEN {share('jqxz')} >= 0.18 THEN 0.18 ELSE 0 END)::DOUBLE"
        f" + (CASE WHEN {share('0-9')} >= 0.25 THEN 0.18 ELSE 0 END)::DOUBLE"
        f" + (CASE WHEN {share('aeiou')} <= 0.22 THEN 0.12 ELSE 0 END)::DOUBLE"
        f" + (CASE WHEN regexp_matches({p}, '[bcdfghjklmnpqrstvwxyz]{{4,}}') THEN 0.12 ELSE 0 END)::DOUBLE, 1.0), 4) END)"
    )


def points(pairs) -> str:
    return " + ".join(f"(CASE WHEN {cond} THEN {pts} ELSE 0 END)::DOUBLE" for cond, pts in pairs)


def reasons(pairs) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in pairs)
    return f"list_filter([{items}], lambda r: r IS NOT NULL)"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)::DOUBLE"


def klass(x: str) -> str:
    return f"CASE WHEN {x} >= 0.72 THEN 'phishing' WHEN {x} >= 0.32 THEN 'suspicious' ELSE 'safe' END"


def sureness(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 0.78 OR {x} <= 0.15 THEN 'high' "
        f"WHEN {x} >= 0.52 OR {x} <= 0.26 THEN 'medium' ELSE 'low' END"
    )


def hmac(x: str, key: str = demo.HMAC_KEY) -> str:
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in block).hex()
    outer = bytes(b ^ 0x5C for b in block).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({x}))))"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' | ')"


# ------------------------------------------------------------------ message views
DEMO_MESSAGES = f"""
templates(tid, sender_email, display_name, subject, lead, href1, anchor1, href2, anchor2, html, source) AS (
  SELECT * FROM (VALUES {values(demo.TEMPLATES)})),
messages AS (
  SELECT d.doc_id AS msg_id, replace(t.sender_email, '{{n}}', d.doc_id::VARCHAR) AS sender_email,
    t.display_name, t.subject, t.lead || ' ' || d.text AS body_text, t.html,
    list_filter([{{'href': replace(t.href1, '{{n}}', d.doc_id::VARCHAR), 'anchor_text': t.anchor1}},
                 {{'href': replace(t.href2, '{{n}}', d.doc_id::VARCHAR), 'anchor_text': t.anchor2}}],
                lambda l: l.href IS NOT NULL) AS links,
    split_part(replace(t.sender_email, '{{n}}', d.doc_id::VARCHAR), '@', -1) AS domain, t.source
  FROM documents d JOIN templates t ON d.doc_id % {len(demo.TEMPLATES)} = t.tid)
"""

_TAG = r"""</?[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[!?][^>]*>"""
_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))[^>]*>(.*?)</a\s*>"""
_BREAK = r"(?i)<br\b[^>]*>|</(?:p|div|h[1-6]|li|tr|article|main|section|blockquote)\s*>"


def unseen(x: str) -> str:
    one = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "template"))
    return f"regexp_replace({x}, '(?is){one}|<!--.*?-->', '<!>', 'g')"


def entities(x: str) -> str:
    x = rf"regexp_replace({x}, '&(?:nbsp|#160|#[xX][aA]0);', chr(160), 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'")):
        x = f"replace({x}, '&{name};', {q(char)})"
    x = f"replace({x}, '&amp;', chr(1))"
    x = rf"regexp_replace({x}, '&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);', chr(183), 'g')"
    return f"replace({x}, chr(1), '&')"


def edges(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def lines(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '{_BREAK}', chr(10), 'g')"
    x = entities(f"regexp_replace({x}, '{_TAG}', '', 'g')")
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {edges('s')}), lambda s: s <> '')"


def pieces(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, '{_TAG}'), lambda s: {edges(entities('s'))}), "
        "lambda s: s <> '')"
    )


def resolve(h: str, base: str) -> str:
    origin = rf"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
    plain = f"regexp_extract({base}, '^[^?#]*')"
    page = f"regexp_extract({base}, '^[^#]*')"
    return (
        rf"CASE WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {h} "
        rf"WHEN starts_with({h}, '//') THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || {h} "
        rf"WHEN starts_with({h}, '/') THEN {origin} || {h} WHEN starts_with({h}, '#') THEN {page} || {h} "
        rf"WHEN starts_with({h}, '?') THEN {plain} || {h} WHEN {h} = '' THEN {page} "
        rf"ELSE (CASE WHEN length({plain}) > length({origin}) THEN regexp_extract({plain}, '^.*/') ELSE {origin} || '/' END) || {h} END"
    )


def heading(tag: str) -> str:
    return f"array_to_string({lines(f'regexp_extract(html, {q(f"(?is)<{tag}{chr(92)}b[^>]*>(.*?)</{tag}{chr(92)}s*>")}, 1)')}, ' ')"


PAGE_PARTS = rf"""
page_roots AS (
  SELECT page_id, url, html,
    CASE WHEN regexp_matches({unseen('html')}, '(?is)<article\b')
      THEN regexp_extract({unseen('html')}, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1)
      ELSE regexp_extract({unseen('html')}, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)', 1) END AS root
  FROM pages),
page_lines AS (SELECT *, {lines('root')} AS shown FROM page_roots),
page_anchors AS (
  SELECT page_id, url, unnest(range(1, len(tags) + 1)) AS pos, unnest(tags) AS tag
  FROM (SELECT page_id, url, regexp_extract_all(root, '{_ANCHOR}') AS tags FROM page_roots)),
page_hrefs AS (
  SELECT page_id, url, pos,
    {entities(edges(f"regexp_extract(tag, '{_ANCHOR}', 1) || regexp_extract(tag, '{_ANCHOR}', 2) || regexp_extract(tag, '{_ANCHOR}', 3)"))} AS raw,
    array_to_string({lines(f"regexp_extract(tag, '{_ANCHOR}', 4)")}, ' ') AS label
  FROM page_anchors),
page_links AS (
  SELECT page_id, pos, {resolve('raw', 'url')} AS href, label FROM page_hrefs),
page_link_lists AS (
  SELECT page_id, list({{'href': href, 'anchor_text': CASE WHEN label <> '' THEN label ELSE href END}} ORDER BY pos) AS links
  FROM page_links GROUP BY page_id),
page_text AS (SELECT *, array_to_string(shown, chr(10)) AS body_text FROM page_lines)
"""
PAGE_MESSAGES = rf"""
{PAGE_PARTS},
messages AS (
  SELECT page_id AS msg_id, sender_email,
    regexp_extract(body_text, '(?i)from:\s*([^\n]+)', 1) AS display_name,
    CASE WHEN regexp_extract(body_text, '(?i)subject:\s*([^\n]+)', 1) <> '' THEN regexp_extract(body_text, '(?i)subject:\s*([^\n]+)', 1)
      WHEN regexp_matches(html, '(?i)<h1\b') THEN {heading('h1')} ELSE {heading('title')} END AS subject,
    body_text, NULL::VARCHAR AS html, coalesce(links, []) AS links,
    CASE WHEN contains(sender_email, '@') THEN split_part(sender_email, '@', -1) ELSE {host('url')} END AS domain,
    'generic' AS source
  FROM (SELECT *, coalesce(nullif(regexp_extract(regexp_extract(html, '(?is)\bhref\s*=\s*["'']?mailto:([^"''>\s]*)', 1), '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}'), ''),
      regexp_extract(body_text, '(?i)from:[^\n]*?([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}})', 1)) AS sender_email FROM page_text)
  LEFT JOIN page_link_lists USING (page_id))
"""

# ------------------------------------------------------------------- triage views
TRIAGE = rf"""
tr_text AS (SELECT *, lower(coalesce(subject, '') || ' ' || coalesce(body_text, '')) AS tt FROM messages),
tr_links AS (
  SELECT msg_id, href, anchor, regexp_replace({host('href')}, '^www\.', '') AS h
  FROM (SELECT msg_id, unnest(links).href AS href, unnest(links).anchor_text AS anchor FROM messages)),
tr_link_counts AS (
  SELECT msg_id,
    count(*) FILTER (WHERE len(regexp_extract_all(coalesce(anchor, ''), '{DOMAIN_RE}')) > 0 AND NOT list_contains(
      list_transform(regexp_extract_all(coalesce(anchor, ''), '{DOMAIN_RE}'), lambda d: array_to_string(({labels('d')})[-2:], '.')),
      array_to_string(({labels('h')})[-2:], '.'))) AS mismatches,
    count(*) FILTER (WHERE regexp_matches(h, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$')) AS ip,
    count(*) FILTER (WHERE split_part(h, '.', -1) IN ({listing(fv.TRIAGE_SUSPICIOUS_TLDS)})) AS tld,
    sum(len(regexp_extract_all(href, '(?i)%[0-9A-F]{{2}}'))) AS encoded
  FROM tr_links GROUP BY msg_id),
tr_brands(brand, known) AS (SELECT * FROM (VALUES {", ".join(f"({q(b)}, [{listing(d)}])" for b, d in fv.TRIAGE_BRANDS)})),
tr_sender AS (
  SELECT msg_id, lower(coalesce(display_name, '') || ' ' || coalesce(subject, '')) AS claim,
    regexp_replace(lower(split_part(CASE WHEN sender_email <> '' THEN sender_email ELSE domain END, '@', -1)), '^www\.', '') AS sd
  FROM messages),
tr_mismatch AS (
  SELECT msg_id, list(brand ORDER BY brand) AS brands
  FROM tr_sender JOIN tr_brands ON contains(claim, brand)
    AND len(list_filter(known, lambda k: sd = k OR ends_with(sd, '.' || k))) = 0
  GROUP BY msg_id),
tr_parts AS (
  SELECT m.*, {phrases('tt', fv.TRIAGE_URGENCY_PHRASES)} AS urgency, {phrases('tt', fv.TRIAGE_CREDENTIAL_PHRASES)} AS credentials,
    {phrases('tt', fv.TRIAGE_FINANCIAL_PHRASES)} AS financial,
    coalesce(mismatches, 0) AS mismatches, coalesce(ip, 0) AS ip, coalesce(tld, 0) AS tld, coalesce(encoded, 0)::BIGINT AS encoded,
    coalesce(brands, []) AS brands,
    lower(CASE WHEN domain <> '' THEN domain ELSE sender_email END) AS sv
  FROM tr_text m LEFT JOIN tr_link_counts USING (msg_id) LEFT JOIN tr_mismatch USING (msg_id)),
tr_scores AS (
  SELECT *, least(1.0, urgency * 0.08::DOUBLE + credentials * 0.18::DOUBLE + financial * 0.1::DOUBLE) AS kw,
    least({points([('mismatches > 0', 0.28), ('ip > 0', 0.22), ('tld > 0', 0.12), ('encoded > 4', 0.08)])}, 1.0) AS lk,
    (CASE WHEN len(brands) > 0 THEN 0.28 ELSE 0 END)::DOUBLE AS br,
    (contains(sv, 'xn--') OR regexp_matches(sv, '[{fv.TRIAGE_HOMOGLYPHS}]')) AS homoglyph,
    {phrases('sv', fv.TRIAGE_SPOOF_TERMS)}::INT AS terms, length(sv) - length(replace(sv, '-', '')) AS hyphens
  FROM tr_parts),
triaged AS (
  SELECT *, least({points([('homoglyph', 0.3), ('terms >= 2', 0.16), ('hyphens >= 3', 0.08)])}, 1.0) AS sp,
    {reasons([('urgency > 0', q(fv.TRIAGE_REASONS['urgency'])), ('credentials > 0', q(fv.TRIAGE_REASONS['credentials'])),
              ('financial > 0', q(fv.TRIAGE_REASONS['financial'])), ('mismatches > 0', q(fv.TRIAGE_REASONS['anchor'])),
              ('ip > 0', q(fv.TRIAGE_REASONS['ip'])), ('tld > 0', q(fv.TRIAGE_REASONS['tld'])),
              ('encoded > 4', q(fv.TRIAGE_REASONS['encoding'])), ('len(brands) > 0', q(fv.TRIAGE_REASONS['brand'])),
              ('homoglyph', q(fv.TRIAGE_REASONS['homoglyph'])), ('terms >= 2', q(fv.TRIAGE_REASONS['terms'])),
              ('hyphens >= 3', q(fv.TRIAGE_REASONS['hyphens']))])} AS client_reasons
  FROM tr_scores),
client AS (
  SELECT msg_id, round(least(greatest(kw * 0.25::DOUBLE + lk * 0.35::DOUBLE + br * 0.25::DOUBLE + sp * 0.15::DOUBLE, 0), 1), 4) AS heuristic_score, client_reasons
  FROM triaged)
"""

# ------------------------------------------------------------------ scoring views
SCORES = rf"""
aliases(alias, pos, brand) AS (SELECT * FROM (VALUES {values(registry_aliases())})),
verified(vdomain, pos, brand) AS (SELECT * FROM (VALUES {values((r['domain'], BRANDS.index(r['brand']), r['brand']) for r in VERIFIED)})),
vlabels(vlabel, pos, brand) AS (SELECT * FROM (VALUES {values(registry_labels())})),
trust(tdomain, brand, trust_type) AS (SELECT * FROM (VALUES {values((r['domain'], r['brand'], r['trust_type']) for r in REGISTRY)})),
masked AS (
  SELECT msg_id, {category('sender_email')} AS category,
    CASE WHEN contains(sender_email, '@') THEN '[local]@' || lower(split_part(sender_email, '@', -1)) ELSE {mask('sender_email')} END AS sender_email,
    {mask('display_name')} AS display_name, {mask('subject')} AS subject, {mask('body_text')} AS body_text, html,
    list_transform(links, lambda l: {{'href': l.href, 'anchor_text': {mask("coalesce(l.anchor_text, '')")}}}) AS links,
    domain, source
  FROM messages),
texts AS (
  SELECT msg_id, trim(regexp_replace(subject || ' ' || body_text, '[\x00{WS}]+', ' ', 'g')) AS text FROM masked),
lowered AS (
  SELECT *, lower(text) AS lt, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9ıſ]+'), lambda w: w <> '') AS tokens FROM texts),
text_counts AS (
  SELECT msg_id, text, len(tokens)::DOUBLE AS word_count,
    CASE WHEN len(tokens) = 0 THEN 0.0 ELSE round(len(list_distinct(tokens))::DOUBLE / len(tokens), 4) END AS unique_word_ratio,
    round(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g'))::DOUBLE / greatest(length(text), 1), 4) AS uppercase_ratio,
    (length(text) - length(replace(text, '!', '')))::DOUBLE AS exclamation_count,
    {phrases('lt', fv.URGENCY_PHRASES)} AS urgency_keyword_count, {phrases('lt', fv.CREDENTIAL_PHRASES)} AS credential_phrase_count,
    {phrases('lt', fv.HIGH_RISK_PHRASES)} AS high_risk_phrase_count, {phrases('lt', fv.SPAM_LURE_PHRASES)} AS spam_lure_keyword_count,
    {phrases('lt', fv.GAMBLING_PHRASES)} AS gambling_keyword_count, {phrases('lt', fv.HINDI_LURE_PHRASES)} AS hindi_spam_lure_count,
    length(regexp_replace(text, '[^{EMOJI}]', '', 'g'))::DOUBLE AS emoji_count,
    len(regexp_extract_all(text, '(?i)\b(?:hxxps?|https?)://\S+|\b(?:[a-z0-9-]+\[\.\])+[a-z]{{2,}}\b'))::DOUBLE AS defanged_url_count
  FROM lowered),
text_features AS (
  SELECT *, round(least(spam_lure_keyword_count * 0.16::DOUBLE + gambling_keyword_count * 0.18::DOUBLE
    + hindi_spam_lure_count * 0.16::DOUBLE + least(emoji_count / 8, 1.0) * 0.18::DOUBLE, 1.0), 4) AS promotional_spam_score
  FROM text_counts),
html_seen AS (SELECT msg_id, html, length(body_text) AS n_body, {unseen('html')} AS seen FROM masked),
html_tags AS (
  SELECT *, {pieces('seen')} AS shown,
    list_filter(regexp_extract_all(seen, '<[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>'), lambda t:
      regexp_matches(regexp_replace(t, '=\s*(?:"[^"]*"|''[^'']*''|[^\s>]+)', '=', 'g'), '(?i)\shidden[\s=/>]')
      OR regexp_matches(t, '(?i:\saria-hidden\s*=\s*)["'']?true["''\s/>]')
      OR regexp_matches(t, '(?i)^<input\b.*\stype\s*=\s*["'']?hidden["''\s/>]')
      OR regexp_matches(t, '(?i:\sstyle\s*=\s*)(?:"[^"]*|''[^'']*)(?:display: ?none|visibility:hidden)')) AS hidden
  FROM html_seen),
structure AS (
  SELECT msg_id, CASE WHEN coalesce(html, '') = '' THEN 0.0 ELSE round(length(html)::DOUBLE / greatest(
      CASE WHEN length(array_to_string(shown, ' ')) > 0 THEN length(array_to_string(shown, ' ')) ELSE n_body END, 1), 4) END AS html_to_text_ratio,
    {flag("regexp_matches(coalesce(seen, ''), '(?i)<form[ />]')")} AS form_tag_presence,
    coalesce(len(hidden), 0)::DOUBLE AS hidden_element_count
  FROM html_tags),
senders AS (
  SELECT *, {norm_domain("(CASE WHEN domain <> '' THEN domain ELSE sender_email END)")} AS sender_host FROM masked),
links AS (
  SELECT msg_id, coalesce(href, '') AS href, coalesce(anchor, '') AS anchor, {host("coalesce(href, '')")} AS plain_host,
    {host(refang("coalesce(href, '')"))} AS host, {path('lower(' + refang("coalesce(href, '')") + ')')} AS path
  FROM (SELECT msg_id, unnest(links).href AS href, unnest(links).anchor_text AS anchor FROM masked)),
hosts AS (SELECT sender_host AS host FROM senders UNION SELECT host FROM links),
suffixes AS (
  SELECT host, i AS cut, array_to_string(string_split(host, '.')[i + 1:], '.') AS suffix
  FROM (SELECT host, unnest(range(0, len(string_split(host, '.')))) AS i FROM hosts)),
host_trust AS (
  SELECT host, min_by(brand, cut) AS trust_brand, min_by(trust_type, cut) AS trust_type FROM suffixes JOIN trust ON suffix = tdomain GROUP BY host),
host_verified AS (
  SELECT host, min_by(brand, pos) AS verified_brand, list(DISTINCT brand) AS verified_for FROM suffixes JOIN verified ON suffix = vdomain GROUP BY host),
host_base AS (
  SELECT h.host, trust_brand, trust_type, verified_brand, coalesce(verified_for, []) AS verified_for, {labels('h.host')} AS parts,
    coalesce({labels('h.host')}[1], '') AS root, replace(split_part(h.host, '.', 1), '-', '') AS compact
  FROM hosts h LEFT JOIN host_trust USING (host) LEFT JOIN host_verified USING (host)),
near_brand AS (
  SELECT host, min(levenshtein({ascii_only('compact')}, alias)) AS dist, arg_min(brand, levenshtein({ascii_only('compact')}, alias) * 100000 + pos) AS brand
  FROM host_base, aliases GROUP BY host),
near_label AS (
  SELECT host, min(levenshtein({ascii_only(skeleton('root'))}, vlabel)) AS dist, arg_min(brand, levenshtein({ascii_only(skeleton('root'))}, vlabel) * 100000 + pos) AS brand
  FROM host_base, vlabels GROUP BY host),
sub_brand AS (
  SELECT host, min_by(brand, pos) AS brand FROM host_base, verified
  WHERE trust_brand IS NULL AND (starts_with(host, vdomain || '.') OR contains(host, '.' || vdomain || '.')) GROUP BY host),
emb_brand AS (
  SELECT host, min_by(v.brand, pos) AS brand
  FROM (SELECT host, unnest(CASE WHEN len(parts) > 2 THEN parts[:-3] ELSE parts[:1] END) AS part FROM host_base WHERE trust_brand IS NULL), vlabels v
  WHERE length(vlabel) >= 5 AND contains(part, vlabel) AND part <> vlabel GROUP BY host),
host_flags AS (
  SELECT b.*, CASE WHEN b.host = '' THEN 1.0 ELSE round(nb.dist::DOUBLE / greatest(length(compact), 1), 4) END AS near_distance,
    CASE WHEN b.host <> '' THEN nb.brand END AS near_brand, nl.dist AS label_distance, nl.brand AS label_brand,
    s.brand AS subdomain_brand, e.brand AS embedded_brand, NOT list_contains(verified_for, nl.brand) AS unverified,
    regexp_matches(b.host, '[^\x00-\x7F]') AS non_ascii,
    (regexp_matches(b.host, '[a-z]|\p{{Latin}}')::INT + regexp_matches(b.host, '\p{{Greek}}')::INT + regexp_matches(b.host, '\p{{Cyrillic}}')::INT
      + regexp_matches(b.host, '[^\P{{L}}\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}]')::INT) > 1 AS mixed
  FROM host_base b JOIN near_brand nb USING (host) JOIN near_label nl USING (host) LEFT JOIN sub_brand s USING (host) LEFT JOIN emb_brand e USING (host)),
host_checks AS (
  SELECT *, non_ascii AND label_distance <= 1 AND unverified AS homograph,
    unverified AND length(root) >= 5 AND label_distance > 0 AND label_distance <= (CASE WHEN length(root) >= 8 THEN 2 ELSE 1 END) AS typosquat,
    contains(host, '-') AND trust_brand IS NULL AND (embedded_brand IS NOT NULL OR (unverified AND regexp_matches(host, '{"|".join(fv.SPOOF_TERMS)}'))) AS hyphenated,
    list_transform(CASE WHEN len(parts) > 2 THEN parts[:-3] ELSE [] END, lambda p: {random_score('p')}) AS label_scores
  FROM host_flags),
host_scores AS (
  SELECT *, {points([('homograph', 0.45), ('mixed', 0.20), ('typosquat', 0.35), ('subdomain_brand IS NOT NULL', 0.45),
                     ('embedded_brand IS NOT NULL', 0.30), ('hyphenated', 0.25), ("contains(host, 'xn--')", 0.30)])} AS raw_lookalike,
    coalesce(list_max(label_scores), 0.0) AS random_label_score,
    regexp_matches(host, '(^|\.)({"|".join(s.replace(".", chr(92) + ".") for s in fv.DELEGATED_SUFFIXES)})$') AS delegated,
    greatest(len(parts) - 2, 0) AS depth, {phrases('host', fv.INFRASTRUCTURE_TERMS)} AS infra_terms
  FROM host_checks),
profile AS (
  SELECT *, round(least(raw_lookalike, 1.0), 4) AS lookalike_score, {flag('homograph')} AS homograph_flag, {flag('mixed')} AS mixed_script_flag,
    {flag('typosquat')} AS typosquat_flag, {flag('subdomain_brand IS NOT NULL OR embedded_brand IS NOT NULL')} AS brand_in_subdomain_flag,
    {flag('hyphenated')} AS suspicious_hyphenated_brand_flag,
    CASE WHEN raw_lookalike > 0 THEN coalesce(embedded_brand, subdomain_brand, label_brand) END AS lookalike_brand,
    round({entropy("replace(host, '.', '')")}, 4) AS sender_domain_entropy, {flag('random_label_score >= 0.45')} AS random_subdomain_flag,
    {flag('delegated')} AS suspicious_delegated_suffix_flag,
    CASE WHEN len(label_scores) = 0 THEN '' ELSE parts[list_position(label_scores, random_label_score)] END AS highest_entropy_label,
    round(least(random_label_score * 0.5::DOUBLE + {points([('random_label_score >= 0.45', 0.20), ('delegated', 0.25), ('depth >= 2', 0.12), ('infra_terms >= 2', 0.08)])}, 1.0), 4) AS domain_infrastructure_score
  FROM host_scores),
link_facts AS (
  SELECT l.*, len(regexp_extract_all(anchor, '{DOMAIN_RE}')) > 0 AND NOT list_contains(
      list_transform(regexp_extract_all(anchor, '{DOMAIN_RE}'), lambda d: {last_two('lower(d)')}), {last_two('plain_host')}) AS mismatch,
    {entropy('href')} AS entropy,
    2 * len(regexp_extract_all(href, '%[0-9A-Fa-f]{{2}}')) + (length(href) - length(replace(href, '%', ''))) AS encoded,
    regexp_full_match(plain_host, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){{4}}') AND NOT ends_with(plain_host, '.') AS ip_host,
    plain_host IN ({listing(fv.BLOCKLIST)}) AS blocklisted, split_part(plain_host, '.', -1) AS tld,
    split_part(plain_host, '.', -1) IN ({listing(fv.SUSPICIOUS_TLDS)}) AS suspicious_tld,
    l.host IN ({listing(fv.SHORTENERS)}) AS shortener,
    p.trust_brand IS NULL AND regexp_matches(path, '{"|".join(r["domain"].replace(".", chr(92) + ".") for r in VERIFIED)}') AS path_flag,
    p.trust_brand IS NULL AND length(href) - length(replace(href, '%', '')) > 4 AS heavy, p.lookalike_score
  FROM links l JOIN profile p ON p.host = l.host),
link_scores AS (
  SELECT *, round(least(lookalike_score + {points([('path_flag', 0.35), ('shortener', 0.20)])}, 1.0), 4) AS url_lookalike FROM link_facts),
link_points AS (
  SELECT *, {points([('blocklisted', 0.45), ('ip_host', 0.22), ("suspicious_tld AND contains(plain_host, '.')", 0.12), ('heavy', 0.08), ('path_flag', 0.26),
                     ('shortener', 0.12), ('url_lookalike >= 0.35', 'least(url_lookalike, 0.45)')])} AS pts,
    {reasons([('blocklisted', q(fv.REASON_BLOCKLIST)), ('ip_host', q(fv.REASON_IP_URL)),
              ("suspicious_tld AND contains(plain_host, '.')", q(fv.REASON_TLD_PREFIX) + " || tld"), ('heavy', q(fv.REASON_ENCODING)),
              ('path_flag', q(fv.REASON_PATH_BRAND)), ('shortener', q(fv.REASON_SHORTENER)), ('url_lookalike >= 0.35', q(fv.REASON_URL_LOOKALIKE))])} AS why
  FROM link_scores),
link_sums AS (
  SELECT msg_id, count(*) FILTER (WHERE href <> '')::DOUBLE AS url_count, max(mismatch::INT)::DOUBLE AS anchor_mismatch_flag,
    count(*) FILTER (WHERE mismatch)::DOUBLE AS anchor_mismatch_count,
    round(coalesce(avg(entropy) FILTER (WHERE href <> ''), 0), 4) AS url_entropy_avg, round(coalesce(max(entropy) FILTER (WHERE href <> ''), 0), 4) AS url_entropy_max,
    max((ip_host AND href <> '')::INT)::DOUBLE AS ip_based_url_flag,
    round(count(*) FILTER (WHERE suspicious_tld AND href <> '')::DOUBLE / greatest(count(*) FILTER (WHERE href <> ''), 1), 4) AS suspicious_tld_score,
    sum(encoded)::DOUBLE AS encoded_character_count, max(url_lookalike) AS url_lookalike_score,
    max(path_flag::INT)::DOUBLE AS url_brand_in_path_flag, max(shortener::INT)::DOUBLE AS generic_shortener_flag,
    round(least(sum(pts::DECIMAL(12,4))::DOUBLE, 1.0), 4) AS link_points, list_sort(list_distinct(flatten(list(why)))) AS link_reasons
  FROM link_points GROUP BY msg_id),
link_features AS (
  SELECT m.msg_id, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in (
      'url_count', 'anchor_mismatch_flag', 'anchor_mismatch_count', 'url_entropy_avg', 'url_entropy_max', 'ip_based_url_flag', 'suspicious_tld_score',
      'encoded_character_count', 'url_lookalike_score', 'url_brand_in_path_flag', 'generic_shortener_flag', 'link_points'))}, coalesce(link_reasons, []) AS link_reasons
  FROM masked m LEFT JOIN link_sums USING (msg_id)),
mention AS (
  SELECT msg_id, min_by(brand, pos) FILTER (WHERE contains(lower(display_name || ' ' || subject), alias)) AS narrow,
    min_by(brand, pos) FILTER (WHERE contains(lower(display_name || ' ' || subject || ' ' || sender_host), alias)) AS wide
  FROM senders, aliases GROUP BY msg_id),
sender_features AS (
  SELECT s.msg_id, s.sender_host, s.category, s.source, p.*, n.narrow, n.wide, CASE WHEN near_distance <= 0.34 THEN near_brand END AS close_brand,
    {flag("contains(p.host, 'xn--')")} AS punycode_detection, depth::DOUBLE AS subdomain_depth, near_distance AS levenshtein_distance_to_brand,
    {flag('narrow IS NOT NULL AND verified_brand IS NULL')} AS display_name_mismatch,
    {flag('near_distance <= 0.34 AND near_brand IS NOT NULL AND verified_brand IS NULL')} AS domain_registry_mismatch
  FROM senders s JOIN profile p ON p.host = s.sender_host JOIN mention n ON n.msg_id = s.msg_id),
features AS (
  SELECT s.*, coalesce(verified_brand, narrow, close_brand, lookalike_brand) AS likely_brand, t.* EXCLUDE (msg_id, text), l.* EXCLUDE (msg_id),
    x.* EXCLUDE (msg_id)
  FROM sender_features s JOIN text_features t ON t.msg_id = s.msg_id JOIN link_features l ON l.msg_id = s.msg_id JOIN structure x ON x.msg_id = s.msg_id),
model AS (
  SELECT *, round(least(greatest({" + ".join(f"least({n} / {full}, 1.0) * {w}::DOUBLE" for n, full, w in fv.FALLBACK_WEIGHTS)}, 0.02), 0.98), 4) AS ml_probability
  FROM features),
impersonation AS (
  SELECT *, {points([('wide IS NOT NULL AND verified_brand IS NULL', 0.34), ('display_name_mismatch > 0', 0.18), ('domain_registry_mismatch > 0', 0.22),
                     (f"regexp_matches(sender_host, '[{fv.HOMOGLYPHS}]')", 0.16), (f"regexp_matches(sender_host, '{'|'.join(fv.SPOOF_TERMS)}')", 0.10)])} AS raw_imp,
    {reasons([('wide IS NOT NULL AND verified_brand IS NULL', q(fv.REASON_BRAND_MENTION)), ('display_name_mismatch > 0', q(fv.REASON_NAME_MISMATCH)),
              ('domain_registry_mismatch > 0', q(fv.REASON_NEAR_BRAND)), (f"regexp_matches(sender_host, '[{fv.HOMOGLYPHS}]')", q(fv.REASON_HOMOGLYPH)),
              (f"regexp_matches(sender_host, '{'|'.join(fv.SPOOF_TERMS)}')", q(fv.REASON_SPOOF_TERM))])} AS imp_reasons
  FROM model),
reputation AS (
  SELECT *, round(least(CASE WHEN verified_brand IS NOT NULL THEN greatest(raw_imp - 0.22::DOUBLE, 0) ELSE raw_imp END, 1.0), 4) AS impersonation_score,
    CASE WHEN verified_brand IS NULL THEN coalesce(wide, CASE WHEN domain_registry_mismatch > 0 THEN coalesce(verified_brand, narrow, close_brand, lookalike_brand) END) END AS impersonated_brand,
    coalesce(trust_type IN ('primary', 'email'), false) OR sender_host = '' AS exempt
  FROM impersonation),
domain_reputation AS (
  SELECT *, CASE WHEN exempt THEN 0.0 ELSE round(least(greatest(domain_infrastructure_score, lookalike_score), 1.0), 4) END AS domain_score,
    CASE WHEN exempt THEN [] ELSE {reasons([('random_subdomain_flag > 0', q(fv.REASON_RANDOM_LABEL)), ('suspicious_delegated_suffix_flag > 0', q(fv.REASON_DELEGATED)),
              ('random_label_score >= 0.6', q(fv.REASON_MACHINE)), ('homograph_flag > 0', q(fv.REASON_HOMOGRAPH)), ('mixed_script_flag > 0', q(fv.REASON_MIXED_SCRIPT)),
              ('typosquat_flag > 0', q(fv.REASON_TYPOSQUAT)), ('brand_in_subdomain_flag > 0', q(fv.REASON_BRAND_SUBDOMAIN)),
              ('suspicious_hyphenated_brand_flag > 0', q(fv.REASON_HYPHEN_BRAND))])} END AS domain_reasons
  FROM reputation),
combined AS (
  SELECT d.*, c.heuristic_score, c.client_reasons, round(greatest(link_points, domain_score), 4) AS link_reputation,
    {reasons([('ml_probability >= 0.7', q(fv.REASON_MODEL)), ('credential_phrase_count > 0', q(fv.REASON_CREDENTIAL)), ('promotional_spam_score >= 0.45', q(fv.REASON_PROMO)),
              ('defanged_url_count > 0', q(fv.REASON_DEFANGED)),
              ('urgency_keyword_count > 0 AND (lookalike_score >= 0.35 OR url_lookalike_score >= 0.35)', q(fv.REASON_URGENT_LOOKALIKE)),
              ('anchor_mismatch_flag > 0', q(fv.REASON_ANCHOR))])} AS feature_reasons
  FROM domain_reputation d JOIN client c USING (msg_id)),
fused AS (
  SELECT *, list_concat(list_concat(list_concat(client_reasons, imp_reasons), list_concat(link_reasons, domain_reasons)), feature_reasons) AS all_reasons FROM combined),
floored AS (
  SELECT *, greatest(0.30::DOUBLE * ml_probability + 0.25::DOUBLE * impersonation_score + 0.20::DOUBLE * heuristic_score + 0.15::DOUBLE * link_reputation + 0.10::DOUBLE * domain_registry_mismatch,
      CASE WHEN link_reputation >= 0.90 THEN 0.34 WHEN link_reputation >= 0.65 THEN 0.32 ELSE 0 END,
      CASE WHEN len(list_filter(all_reasons, lambda r: contains(r, 'gambling or prize-lure spam'))) > 0 THEN 0.34 ELSE 0 END,
      CASE WHEN len(list_filter(all_reasons, lambda r: contains(lower(r), 'lookalike') OR contains(lower(r), 'look-alike'))) > 0 THEN 0.38 ELSE 0 END) AS floor_score
  FROM fused),
risk AS (
  SELECT *, round(least(greatest(CASE WHEN verified_brand IS NOT NULL AND category IN ('noreply', 'notification') THEN greatest(floor_score - 0.04::DOUBLE, 0) ELSE floor_score END, 0), 1), 4) AS risk_score
  FROM floored),
assessed AS (
  SELECT *, {klass('risk_score')} AS classification, {sureness('risk_score')} AS confidence,
    array_to_string(list_sort(list_distinct(list_filter(all_reasons, lambda r: r <> ''))), ' | ') AS reasons
  FROM risk)
"""

RISK_EVENTS = f"""
scored AS (
  SELECT *, round(least(value / 100, 1.0), 4) AS risk FROM events),
risk_events AS (
  SELECT event_id AS id, sha256(props) AS sample_hash, sha256(user_id::VARCHAR) AS sender_hash, sha256(event_type) AS subject_hash,
    event_type || '.example' AS domain, 'api' AS source, risk AS risk_score, {klass('risk')} AS classification, {sureness('risk')} AS confidence,
    CASE event_type WHEN 'purchase' THEN 'PayPal' WHEN 'signup' THEN 'Google' WHEN 'error' THEN 'Microsoft' END AS impersonated_brand,
    list_filter([CASE WHEN risk >= 0.32 THEN event_type END, CASE WHEN risk >= 0.72 THEN 'high value' END], lambda r: r IS NOT NULL) AS reasons, ts AS created_at
  FROM scored)
"""
FEEDBACK = f"""
feedback AS (
  SELECT event_id AS feedback_id, sha256(user_id::VARCHAR) AS sample_hash, 'user' || user_id::VARCHAR || '.example' AS domain, 'extension' AS source,
    round(value / 100, 4) AS current_risk_score, {klass('round(value / 100, 4)')} AS current_classification,
    CASE event_type WHEN 'click' THEN 'mark_not_risky' ELSE 'report_risky' END AS user_feedback, ts AS created_at
  FROM events WHERE event_type IN ('click', 'error') AND round(value / 100, 4) <= 1)
"""
# Documents whose first line is the subject of a message and its only reason.
BAD_HEADS = """
lead(tid, lead) AS (SELECT * FROM (VALUES LEADS)),
heads AS (
  SELECT doc_id AS msg_id, array_to_string(list_filter([CASE WHEN length(split_part(lead || ' ' || text, chr(10), 1)) > 512 THEN 'subject' END,
      CASE WHEN length(lead || ' ' || text) > 50000 THEN 'body_text' END,
      CASE WHEN length(split_part(lead || ' ' || text, chr(10), 1)) > 240 THEN 'client_reason' END], lambda v: v IS NOT NULL), ' | ') AS violations
  FROM documents JOIN lead ON tid = doc_id % TEMPLATE_COUNT)
""".replace("LEADS", values((t[0], t[4]) for t in demo.TEMPLATES)).replace("TEMPLATE_COUNT", str(len(demo.TEMPLATES)))
ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f')"


def over_messages(select: str) -> str:
    return f"WITH {DEMO_MESSAGES}, {TRIAGE}, {SCORES} {select}"


def over_pages(select: str) -> str:
    return f"WITH {PAGE_MESSAGES}, {TRIAGE}, {SCORES} {select}"


def over_events(select: str) -> str:
    return f"WITH {RISK_EVENTS} {select}"


FEED_SQL = f"""
feed AS (SELECT trim(l.href) AS url, lower(source) AS source, TIMESTAMP '2024-01-01' + msg_id * INTERVAL 7 MINUTE AS first_seen
  FROM (SELECT msg_id, source, unnest(links) AS l FROM messages)),
feeds AS (SELECT url, {host('url')} AS domain, source, min(first_seen) AS first_seen FROM feed GROUP BY url, source)
"""
FIRST_FEEDBACK = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_hash, user_feedback ORDER BY created_at, feedback_id) AS rn FROM feedback),
first_ones AS (SELECT * FROM ranked WHERE rn = 1)
"""
PREDICTIONS = """
predictions AS (
  SELECT doc_id, quality AS label, round(least(n_chars / 5000, 1.0), 3) AS score, (round(least(n_chars / 5000, 1.0), 3) >= 0.3)::INT AS prediction
  FROM documents JOIN labels USING (doc_id)),
counts AS (
  SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM predictions)
"""


def accepted(window_ms: int, test: str) -> str:
    """Fold the events of each user in time order, keeping the last accepted time."""
    return f"""WITH RECURSIVE ordered AS (
        SELECT user_id, event_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events),
      fold AS (
        SELECT user_id, event_id, rn, t AS last_t, true AS accepted FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.user_id, o.event_id, o.rn, CASE WHEN o.t - f.last_t {test} {window_ms} THEN o.t ELSE f.last_t END, o.t - f.last_t {test} {window_ms}
        FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.rn = f.rn + 1)"""


def accepted_payload(window_ms: int) -> str:
    """The same fold, which keeps the payload of the last accepted event as well."""
    ok = f"o.t - f.last_t >= {window_ms} AND (o.payload IS NULL OR f.payload IS NULL OR o.payload <> f.payload)"
    return f"""WITH RECURSIVE ordered AS (
        SELECT user_id, event_id, epoch_ms(ts) AS t, CASE WHEN event_type <> 'error' THEN event_type END AS payload,
          row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events),
      fold AS (
        SELECT user_id, event_id, rn, t AS last_t, payload, true AS accepted FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.user_id, o.event_id, o.rn, CASE WHEN {ok} THEN o.t ELSE f.last_t END, CASE WHEN {ok} THEN o.payload ELSE f.payload END, {ok}
        FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
      SELECT event_id, accepted FROM fold"""


def _report() -> str:
    def measures(hit, wrong, missed):
        p = f"(CASE WHEN {hit} + {wrong} > 0 THEN {hit}::DOUBLE / ({hit} + {wrong}) ELSE 0 END)"
        r = f"(CASE WHEN {hit} + {missed} > 0 THEN {hit}::DOUBLE / ({hit} + {missed}) ELSE 0 END)"
        return p, r, f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END)", f"({hit} + {missed})"

    zero, one = measures("tn", "fn", "fp"), measures("tp", "fp", "fn")
    total = "(tp + fp + fn + tn)"
    acc = f"(tp + tn)::DOUBLE / {total}"
    rows = [("0", *zero), ("1", *one), ("accuracy", acc, acc, acc, total)]
    rows.append(("macro avg", *[f"({a} + {b}) / 2" for a, b in zip(zero[:3], one[:3])], total))
    rows.append(("weighted avg", *[f"({a} * {zero[3]} + {b} * {one[3]}) / {total}" for a, b in zip(zero[:3], one[:3])], total))
    parts = [
        f"SELECT '{n}' AS name, round({p}, 4) AS precision, round({r}, 4) AS recall, round({f}, 4) AS f1, {s} AS support FROM counts"
        for n, p, r, f, s in rows
    ]
    return f"WITH {PREDICTIONS} " + " UNION ALL ".join(parts)


def statements() -> dict[str, str]:
    esc = r"""array_to_string(list_transform(regexp_extract_all(j, '(?s).'), lambda c: CASE WHEN unicode(c) < 127 THEN c
        WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c))
        ELSE printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), '')"""
    canonical = f"""
      canon AS (SELECT msg_id, '{{"body_text":' || to_json(body_text) || ',"links":[' ||
        array_to_string(list_transform(links, lambda l: '{{"anchor_text":' || to_json(l.anchor_text) || ',"href":' || to_json(l.href) || '}}'), ',') ||
        '],"sender_email":' || to_json(sender_email) || ',"subject":' || to_json(subject) || '}}' AS j FROM messages),
      hashed AS (SELECT msg_id, sha256({esc}) AS sample_hash FROM canon)"""
    features_numeric = ", ".join(fv.NUMERIC_FEATURES)
    host_labels = "(SELECT DISTINCT unnest(parts) AS label FROM host_base)"
    rates = """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, user_id::VARCHAR AS client, count(*) AS n_requests,
        count(*) > 1 AS over_limit FROM events GROUP BY 1, 2"""
    rule_flags = {
        "display_name_mismatch": "display_name_mismatch > 0", "domain_registry_mismatch": "domain_registry_mismatch > 0",
        "anchor_mismatch_flag": "anchor_mismatch_flag > 0", "punycode_detection": "punycode_detection > 0",
        "homoglyph": f"regexp_matches(sender_host, '[{fv.HOMOGLYPHS}]')",
    }
    rule_parts = " UNION ALL ".join(
        f"SELECT msg_id, {q(rid)} AS rule_id, {q(sev)} AS severity FROM rule_rows WHERE "
        + " OR ".join(rule_flags.get(p, f"contains(lt, {q(p)})") for p in patterns)
        for rid, _, sev, patterns in fv.DETECTION_RULES
    )
    lens = " ".join(
        f"CASE WHEN length({c}) > {n} THEN {q(c)} END," for c, n in fv.MAX_LENGTHS.items()
    )
    return {
        # privacy
        "mask_pii": f"SELECT doc_id, md5({mask('text')}) AS masked_md5 FROM documents",
        "mask_turns": f"SELECT conv_id, turn, md5({mask('text', cards=False)}) AS masked_md5 FROM conversations",
        "sender_category": over_messages(f"SELECT msg_id, {category('sender_email')} AS category, '[local]@' || lower(split_part(sender_email, '@', -1)) AS masked_sender FROM messages"),
        "mask_payload": over_messages("""SELECT msg_id, sender_email, display_name, subject, md5(body_text) AS body_md5,
            array_to_string(list_transform(links, lambda l: l.anchor_text), ' | ') AS anchors, array_to_string(list_transform(links, lambda l: l.href), ' | ') AS hrefs, domain FROM masked"""),
        "hmac_ids": over_messages(f"SELECT msg_id, {hmac('sender_email')} AS sender_hash, {hmac('subject')} AS subject_hash FROM messages"),
        "canonical_hash": f"WITH {DEMO_MESSAGES}, {canonical} SELECT * FROM hashed",
        # text
        "text_stats": over_messages("SELECT msg_id, word_count, unique_word_ratio, uppercase_ratio, exclamation_count, emoji_count, md5(text) AS text_md5 FROM text_features"),
        "phrase_counts": over_messages("SELECT msg_id, urgency_keyword_count, credential_phrase_count, high_risk_phrase_count, spam_lure_keyword_count, gambling_keyword_count, hindi_spam_lure_count FROM text_features"),
        "promo_score": over_messages("SELECT msg_id, promotional_spam_score FROM text_features"),
        "defanged_count": over_messages(f"SELECT msg_id, defanged_url_count, array_to_string(regexp_extract_all({refang('text')}, '{DOMAIN_RE}'), ' | ') AS domains FROM text_features"),
        # links and URLs
        "url_hosts": over_messages(f"SELECT msg_id, href, plain_host, host, path, {last_two('plain_host')} AS registered FROM links"),
        "page_urls": f"SELECT page_id, {host('url')} AS host, {path('url')} AS path, round({entropy('url')}, 4) AS entropy, split_part({host('url')}, '.', -1) AS tld, {norm_domain('url')} AS domain FROM pages",
        "url_entropy": over_messages("SELECT msg_id, href, round(entropy, 4) AS entropy FROM link_facts"),
        "anchor_mismatch": over_messages("SELECT msg_id, href, anchor, mismatch FROM link_facts"),
        "encoded_chars": over_messages("SELECT msg_id, href, encoded::DOUBLE AS encoded, length(href) - length(replace(href, '%', '')) > 4 AS heavy FROM link_facts"),
        "ip_hosts": over_messages("SELECT msg_id, plain_host AS host, ip_host AS is_ip FROM link_facts"),
        "suspicious_tld": over_messages(f"SELECT msg_id, plain_host AS host, tld, suspicious_tld AS suspicious, blocklisted, plain_host IN ({listing(fv.SHORTENERS)}) AS shortener FROM link_facts"),
        "links_in_text": over_messages(r"""SELECT msg_id, len(found) AS n_links, list_max(found) AS last_link FROM (
            SELECT msg_id, regexp_extract_all(body_text || ' ' || array_to_string(list_transform(links, lambda l: l.href), ' '), '(?i)https?://\S+|www\.\S+') AS found FROM messages) WHERE len(found) > 0"""),
        # domains and hosts
        "normalize_domain": over_messages(f"SELECT msg_id, {norm_domain('sender_email')} AS from_address, sender_host FROM senders"),
        "subdomain_depth": over_messages("SELECT host, depth, root, delegated FROM profile"),
        "random_label": over_messages(f"SELECT label, {random_score('label')} AS score, round({entropy('label')}, 4) AS entropy FROM {host_labels}"),
        "infra_score": over_messages("SELECT host, sender_domain_entropy, random_label_score, random_subdomain_flag, suspicious_delegated_suffix_flag, domain_infrastructure_score, highest_entropy_label FROM profile"),
        "trust_lookup": over_messages("SELECT host, trust_brand, trust_type, coalesce(trust_type IN ('primary', 'email'), false) AS strong_sender FROM host_base"),
        "verified_brand": over_messages("SELECT host, verified_brand, len(verified_for) AS n_brands FROM host_base"),
        "brand_mentions": over_messages("""SELECT msg_id, coalesce(brands, '') AS brands FROM masked LEFT JOIN (
            SELECT msg_id, string_agg(brand, ' | ' ORDER BY pos) AS brands FROM (
              SELECT DISTINCT msg_id, brand, pos FROM masked, aliases WHERE contains(lower(display_name || ' ' || subject), alias)) GROUP BY msg_id) USING (msg_id)"""),
        "nearest_brand": over_messages("SELECT host, near_distance, near_brand FROM host_flags"),
        "nearest_label": over_messages(f"SELECT host, {skeleton('root')} AS skeleton, label_distance, label_brand FROM host_flags"),
        "brand_in_subdomain": over_messages("SELECT host, brand AS subdomain_brand FROM sub_brand"),
        "embedded_brand": over_messages("SELECT host, brand AS embedded_brand FROM emb_brand"),
        "brand_in_path": over_messages("SELECT msg_id, href, (SELECT min_by(brand, pos) FROM verified WHERE contains(path, vdomain)) AS path_brand FROM links"),
        "name_sets": over_messages("""SELECT p.host, p.host IN (SELECT vdomain FROM verified) OR p.host IN (SELECT tdomain FROM trust) AS domain, p.host IN (SELECT tdomain FROM trust) AS trusted,
            p.host IN (SELECT tdomain FROM trust WHERE trust_type NOT IN ('primary', 'email')) AS weak, p.root IN (SELECT alias FROM aliases) AS term FROM profile p"""),
        "trust_from_table": f"""WITH listed AS (SELECT DISTINCT {host('url')} AS domain FROM pages WHERE {host('url')} <> ''),
            trust AS (SELECT domain, 'Brand of ' || domain AS brand, ['primary', 'email', 'asset'][length(domain) % 3 + 1] AS kind FROM listed),
            names AS (SELECT 'www.' || domain AS host FROM listed UNION SELECT domain FROM listed UNION SELECT 'a.' || domain FROM listed),
            parts AS (SELECT host, string_split(host, '.') AS w FROM names),
            suffixes AS (SELECT host, i AS cut, array_to_string(w[i + 1:], '.') AS suffix FROM parts, LATERAL (SELECT unnest(range(len(w))) AS i)),
            met AS (SELECT host, cut, brand, kind, cut = 0 AND starts_with(host, 'www.') AS www FROM suffixes JOIN trust ON suffix = domain)
            SELECT n.host, min_by(brand, cut) FILTER (WHERE NOT www) AS brand, min_by(kind, cut) FILTER (WHERE NOT www) AS trust_type,
              count(brand) FILTER (WHERE kind IN ('primary', 'email')) AS n_verified FROM names n LEFT JOIN met m ON m.host = n.host GROUP BY n.host""",
        "links_without_href": over_messages(f"""SELECT m.msg_id, coalesce(u, 0)::DOUBLE AS url_count, round(coalesce(e, 0), 4) AS url_entropy_max FROM messages m LEFT JOIN (
              SELECT msg_id, count(*) AS u, max({entropy('href')}) AS e FROM (
                SELECT msg_id, unnest(list_transform(links, lambda l: l.href)) AS href, unnest(range(len(links))) AS i FROM messages) WHERE i % 3 = 2 AND href <> '' GROUP BY msg_id) c ON c.msg_id = m.msg_id"""),
        "domain_lookalike": over_messages("SELECT host, lookalike_score, homograph_flag, mixed_script_flag, typosquat_flag, brand_in_subdomain_flag, suspicious_hyphenated_brand_flag, lookalike_brand FROM profile"),
        "url_lookalike": over_messages("SELECT msg_id, host, url_lookalike, path_flag, shortener, round(pts, 4) AS points FROM link_points"),
        "sender_features": over_messages("""SELECT msg_id, sender_host, verified_brand AS recognized_brand, trust_type AS domain_trust_type, punycode_detection, subdomain_depth,
            levenshtein_distance_to_brand, display_name_mismatch, domain_registry_mismatch, likely_brand, sender_domain_entropy, random_label_score,
            domain_infrastructure_score, highest_entropy_label, lookalike_score, lookalike_brand FROM features"""),
        "link_features": over_messages("SELECT * EXCLUDE (link_points, link_reasons) FROM link_features"),
        "link_reputation": over_messages(f"SELECT msg_id, link_points, {joined('link_reasons')} AS link_reasons FROM link_features"),
        "structure_features": over_messages("SELECT * FROM structure"),
        "page_structure": f"""WITH messages AS (SELECT page_id AS msg_id, '' AS sender_email, '' AS display_name, '' AS subject, '' AS body_text, html,
            [{{'href': '', 'anchor_text': ''}}] AS links, '' AS domain, '' AS source FROM pages), {TRIAGE}, {SCORES}
            SELECT msg_id AS page_id, html_to_text_ratio, form_tag_presence, hidden_element_count FROM structure""",
        # scoring
        "fallback_probability": over_messages("SELECT msg_id, ml_probability FROM model"),
        "feature_frame": over_messages(f"SELECT msg_id, {features_numeric} FROM features"),
        "impersonation": over_messages(f"SELECT msg_id, impersonation_score, impersonated_brand, {joined('imp_reasons')} AS why FROM reputation"),
        "domain_reputation": over_messages(f"SELECT msg_id, domain_score AS domain_reputation, {joined('domain_reasons')} AS why FROM domain_reputation"),
        "reputation": over_messages("SELECT msg_id, link_reputation FROM combined"),
        "assess_reasons": over_messages("SELECT msg_id, reasons FROM assessed"),
        "fused_score": over_messages("SELECT msg_id, risk_score, classification, confidence FROM assessed"),
        "assess": f"""WITH {DEMO_MESSAGES}, {canonical}, {TRIAGE}, {SCORES} SELECT msg_id, sample_hash, sender_host AS domain, source, risk_score, classification, confidence,
            impersonated_brand, reasons, ml_probability, impersonation_score, heuristic_score, link_reputation, domain_registry_mismatch FROM assessed JOIN hashed USING (msg_id)""",
        "page_assess": over_pages("SELECT msg_id, sender_host AS domain, risk_score, classification, confidence, impersonated_brand, reasons FROM assessed"),
        "assessed_summary": over_messages("""SELECT count(*) AS total_events, count(*) FILTER (WHERE classification = 'phishing') AS phishing,
            count(*) FILTER (WHERE classification = 'suspicious') AS suspicious, count(*) FILTER (WHERE classification = 'safe') AS safe, round(avg(risk_score), 4) AS average_risk FROM assessed"""),
        "assessed_brands": over_messages("""SELECT impersonated_brand AS brand, count(*) AS n_events, round(avg(risk_score), 4) AS average_risk FROM assessed
            WHERE impersonated_brand IS NOT NULL GROUP BY 1 ORDER BY n_events DESC, brand LIMIT 10"""),
        "event_table": f"""WITH {DEMO_MESSAGES}, {canonical}, {TRIAGE}, {SCORES} SELECT a.msg_id AS id, sample_hash, {hmac('m.sender_email')} AS sender_hash, {hmac('m.subject')} AS subject_hash,
            sender_host AS domain, risk_score, classification, url_count, likely_brand, strftime(TIMESTAMP '2024-01-01' + a.msg_id * INTERVAL 7 MINUTE, '%Y-%m-%d') AS event_date
            FROM assessed a JOIN hashed USING (msg_id) JOIN messages m ON m.msg_id = a.msg_id""",
        # triage
        "triage_keyword": over_messages("SELECT msg_id, urgency AS kw_urgency, credentials AS kw_credentials, financial AS kw_financial, round(kw, 4) AS keyword_score FROM triaged"),
        "triage_link": over_messages("SELECT msg_id, mismatches, ip, tld, encoded, round(lk, 4) AS link_score FROM triaged"),
        "triage_domain": over_messages("SELECT msg_id, array_to_string(brands, ' | ') AS brands, br AS brand_score FROM triaged"),
        "triage_spoof": over_messages("SELECT msg_id, homoglyph AS sp_homoglyph, terms::BIGINT AS sp_terms, hyphens AS sp_hyphens, round(sp, 4) AS spoof_score FROM triaged"),
        "triage_score": over_messages("SELECT msg_id, heuristic_score, array_to_string(client_reasons, ' | ') AS client_reasons FROM client"),
        "triage_split": over_messages("SELECT msg_id, CASE WHEN heuristic_score >= 0.28 OR len(links) > 0 THEN 'full' ELSE 'safe' END AS route FROM client JOIN messages USING (msg_id) WHERE length(body_text) > 0 OR len(links) > 0"),
        "validate_messages": over_messages(f"""SELECT msg_id, array_to_string(list_filter([{lens}
            CASE WHEN len(links) > 200 THEN 'links' END, CASE WHEN len(list_filter(links, lambda l: l.href IS NULL OR length(l.href) > 2048)) > 0 THEN 'href' END,
            CASE WHEN len(list_filter(links, lambda l: length(l.anchor_text) > 512)) > 0 THEN 'anchor_text' END], lambda v: v IS NOT NULL), ' | ') AS violations FROM messages"""),
        "validate_feedback": """SELECT event_id AS feedback_id, array_to_string(list_filter([CASE WHEN round(value / 100, 4) > 1 THEN 'current_risk_score' END,
            CASE WHEN event_type NOT IN ('click', 'error') THEN 'user_feedback' END], lambda v: v IS NOT NULL), ' | ') AS violations FROM events""",
        "quarantined_messages": f"WITH {BAD_HEADS} SELECT msg_id, violations FROM heads WHERE violations <> ''",
        "assess_valid": f"WITH {DEMO_MESSAGES}, {BAD_HEADS} SELECT msg_id, {norm_domain('domain')} AS domain, source FROM messages JOIN heads USING (msg_id) WHERE violations = ''",
        # pages
        "page_messages": over_pages("SELECT msg_id, sender_email, display_name, subject, md5(body_text) AS body_md5, len(links) AS n_links, domain FROM messages"),
        "page_links": f"""WITH anchors AS (SELECT page_id, url, unnest(range(1, len(tags) + 1)) AS pos, unnest(tags) AS tag
              FROM (SELECT page_id, url, regexp_extract_all({unseen('html')}, '{_ANCHOR}') AS tags FROM pages)),
            parts AS (SELECT page_id, url, pos, {entities(edges(f"regexp_extract(tag, '{_ANCHOR}', 1) || regexp_extract(tag, '{_ANCHOR}', 2) || regexp_extract(tag, '{_ANCHOR}', 3)"))} AS raw,
              array_to_string({lines(f"regexp_extract(tag, '{_ANCHOR}', 4)")}, ' ') AS label FROM anchors),
            found AS (SELECT page_id, pos, {resolve('raw', 'url')} AS href, label FROM parts)
            SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos, href, CASE WHEN label <> '' THEN label ELSE href END AS anchor FROM found WHERE NOT starts_with(lower(href), 'mailto:')""",
        "page_is_mail": f"""SELECT page_id, NOT ({host('url')} = 'mail.google.com' OR contains({host('url')}, 'outlook.')) AND (
            regexp_matches(array_to_string({lines(unseen('html'))}, chr(10)), '(?im)^\\s*(?:from|sender|subject|to):')
            OR regexp_matches(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*["'']?mailto:')) AS is_mail FROM pages""",
        "longest_block": f"""WITH {PAGE_PARTS}, blocks AS (SELECT page_id, unnest(shown) AS block, unnest(range(len(shown))) AS pos FROM page_lines),
            longest AS (SELECT page_id, arg_max(block, length(block) * 100000 - pos) AS block FROM blocks GROUP BY page_id)
            SELECT page_id, length(coalesce(block, '')) AS n_chars, md5(coalesce(block, '')) AS block_md5 FROM pages LEFT JOIN longest USING (page_id)""",
        # reports
        "summary": over_events("""SELECT count(*) AS total_events, count(*) FILTER (WHERE classification = 'phishing') AS phishing,
            count(*) FILTER (WHERE classification = 'suspicious') AS suspicious, count(*) FILTER (WHERE classification = 'safe') AS safe, round(avg(risk_score), 4) AS average_risk FROM risk_events"""),
        "class_share": over_events("SELECT classification, count(*) AS n_events, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM risk_events GROUP BY 1"),
        "daily_trend": over_events("""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n_events, round(avg(risk_score), 4) AS average_risk FROM risk_events
            WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 1 ORDER BY 1"""),
        "top_brands": over_events("""SELECT impersonated_brand AS brand, count(*) AS n_events, round(avg(risk_score), 4) AS average_risk FROM risk_events
            WHERE impersonated_brand IS NOT NULL GROUP BY 1 ORDER BY n_events DESC, brand LIMIT 10"""),
        "recent_events": over_events(f"""SELECT id, sample_hash, sender_hash, subject_hash, domain, source, risk_score, classification, confidence, impersonated_brand,
            array_to_string(reasons, ' | ') AS reasons, {ISO} AS created_at FROM risk_events ORDER BY risk_events.created_at DESC, id DESC LIMIT 25"""),
        "shown_reasons": over_events("SELECT id, array_to_string(reasons[1:1], ' | ') AS first_1, array_to_string(reasons[1:4], ' | ') AS first_4 FROM risk_events"),
        "risk_points": over_events(f"SELECT id, {ISO} AS created_at, risk_score, classification, domain FROM (SELECT * FROM risk_events ORDER BY created_at DESC, id DESC LIMIT 336)"),
        "normalized_points": over_events("SELECT id, strftime(created_at, '%H:%M') AS label, least(greatest(risk_score, 0), 1) AS risk FROM risk_events"),
        "event_points": over_events("""SELECT id, CASE WHEN id % 3 > 0 THEN strftime(created_at, '%H:%M') ELSE 'Event ' || row_number() OVER (ORDER BY created_at, id) END AS label,
            least(greatest(risk_score, 0), 1) AS risk FROM (SELECT * FROM risk_events ORDER BY created_at DESC, id DESC LIMIT 60)"""),
        "last_points": over_events("SELECT id, strftime(created_at, '%H:%M') AS label, least(greatest(risk_score, 0), 1) AS risk FROM (SELECT * FROM risk_events ORDER BY created_at DESC, id DESC LIMIT 3)"),
        "class_events": over_events("SELECT id, risk_score FROM risk_events WHERE classification = 'phishing'"),
        "siem_events": over_events(f"""SELECT CASE WHEN classification <> 'safe' THEN 'alert' ELSE 'event' END AS event_kind, 'email | threat' AS event_category, 'indicator' AS event_type,
            'msgrisk' AS event_module, {ISO} AS event_created, 'email' AS threat_indicator_type, confidence AS threat_indicator_confidence, sample_hash AS msgrisk_sample_hash,
            sender_hash AS msgrisk_sender_hash, subject_hash AS msgrisk_subject_hash, domain AS msgrisk_domain, risk_score AS msgrisk_risk_score, classification AS msgrisk_classification,
            impersonated_brand AS msgrisk_impersonated_brand, array_to_string(reasons, ' | ') AS msgrisk_reasons FROM risk_events"""),
        "siem_envelope": over_events(f"""SELECT 'msgrisk.siem.v1' AS schema, 'json' AS format, count(*) AS count,
            string_agg({ISO} || CASE WHEN classification <> 'safe' THEN ' alert ' ELSE ' event ' END || sample_hash, ' | '
              ORDER BY {ISO} || CASE WHEN classification <> 'safe' THEN ' alert ' ELSE ' event ' END || sample_hash) AS events FROM (SELECT * FROM risk_events ORDER BY created_at DESC, id DESC LIMIT 100)"""),
        "rate_minute": rates,
        "rate_clients": """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute,
            CASE event_type WHEN 'view' THEN '10.0.0.' || user_id WHEN 'signup' THEN 'local' ELSE 'peer' || user_id END AS client,
            count(*) AS n_requests, count(*) > 1 AS over_limit FROM events WHERE event_type <> 'error' GROUP BY 1, 2""",
        "message_source": f"WITH {DEMO_MESSAGES} SELECT msg_id, subject, source, 0.0::DOUBLE AS heuristic_score, 0::BIGINT AS n_reasons, len(links) AS n_links, md5(body_text) AS body_md5 FROM messages",
        "ttl_cache": accepted(21600000, ">") + " SELECT event_id, NOT accepted AS is_hit FROM fold",
        "cooldown": accepted(7200000, ">=") + " SELECT event_id, accepted FROM fold",
        "fresh_entries": "SELECT event_id AS id FROM events WHERE epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - epoch_ms(ts) <= 86400000",
        # feedback
        "feedback_first": f"WITH {FEEDBACK}, {FIRST_FEEDBACK} SELECT sample_hash, user_feedback, feedback_id, current_risk_score FROM first_ones",
        "feedback_new": f"""WITH {FEEDBACK}, {FIRST_FEEDBACK} SELECT sample_hash, user_feedback, feedback_id, 'pending' AS review_status FROM first_ones WHERE created_at >= TIMESTAMP '2024-01-16'""",
        "recent_feedback": f"""WITH {FEEDBACK}, {FIRST_FEEDBACK} SELECT feedback_id, sample_hash, CASE user_feedback WHEN 'mark_not_risky' THEN 'Marked not risky' ELSE 'Reported risky' END AS feedback_label,
            'pending' AS review_status, {ISO} AS created_at FROM first_ones ORDER BY first_ones.created_at DESC, feedback_id DESC LIMIT 50""",
        # rules and feeds
        "rule_hits": over_messages(f"SELECT * FROM (WITH rule_rows AS (SELECT f.*, lower(t.text) AS lt FROM features f JOIN texts t ON t.msg_id = f.msg_id) {rule_parts})"),
        "feed_normalize": f"WITH {DEMO_MESSAGES}, {FEED_SQL} SELECT url, domain, source, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, 0.5::DOUBLE AS confidence FROM feeds",
        "indicator_expiry": f"""WITH {DEMO_MESSAGES}, {FEED_SQL} SELECT url, source FROM feeds
            WHERE first_seen + to_days(CASE source WHEN 'gmail' THEN 1 WHEN 'generic' THEN 2 WHEN 'outlook' THEN 3 ELSE 4 END) >= TIMESTAMP '2024-01-04'""",
        "known_links": f"""WITH {DEMO_MESSAGES}, {FEED_SQL}, live AS (SELECT domain, source, first_seen + INTERVAL 1 DAY AS a,
              first_seen + INTERVAL 1 DAY + to_days(CASE source WHEN 'gmail' THEN 1 ELSE 2 END) AS b FROM feeds WHERE source <> 'generic' AND domain <> ''),
            sent AS (SELECT msg_id, TIMESTAMP '2024-01-01' + msg_id * INTERVAL 7 MINUTE AS t, unnest(range(len(links))) AS place, unnest(links) AS l FROM messages),
            met AS (SELECT DISTINCT msg_id, place, domain, live.source FROM sent JOIN live ON domain = {host('l.href')} AND t BETWEEN a AND b)
            SELECT msg_id, place, domain AS host, string_agg(source, ' | ' ORDER BY source) AS known_by FROM met GROUP BY msg_id, place, domain""",
        # learning
        "training_csv": "SELECT doc_id, toxic AS label, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL",
        "threshold_fpr": f"""WITH {PREDICTIONS}, points AS (
              SELECT score, sum(sum(label)) OVER w AS tp, sum(sum(1 - label)) OVER w AS fp FROM predictions GROUP BY score WINDOW w AS (ORDER BY score DESC)),
            whole AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM predictions),
            best AS (SELECT score, tp, fp, p, n FROM points, whole WHERE fp <= 0.2::DOUBLE * n ORDER BY tp DESC, fp, score DESC LIMIT 1)
            SELECT score AS threshold, round(tp / p, 6) AS recall, round(fp / n, 6) AS fpr, round(tp / (tp + fp), 6) AS precision,
              tp::BIGINT AS tp, fp::BIGINT AS fp, (p - tp)::BIGINT AS fn, (n - fp)::BIGINT AS tn FROM best""",
        "label_normalize": "SELECT doc_id, toxic, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS label FROM labels",
        "class_weights": "SELECT toxic AS label, count(*) AS n_rows, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight FROM labels JOIN documents USING (doc_id) GROUP BY 1",
        "deduplicated_texts": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(regexp_replace(text, '[\\x00{WS}]+', ' ', 'g')))",
        "ngram_vocab": """WITH tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]{2,}') AS w FROM documents),
            terms AS (SELECT doc_id, unnest(w) AS term FROM tokens UNION ALL
              SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tokens)
            SELECT term, count(*) AS n_total, count(DISTINCT doc_id) AS n_docs FROM terms GROUP BY term ORDER BY n_total DESC, term LIMIT 8000""",
        "stratified_split": """SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id)
            <= floor(count(*) OVER (PARTITION BY toxic) * 0.25 + 0.5) AS is_test FROM labels""",
        "confusion_matrix": f"WITH {PREDICTIONS} SELECT tp, fp, fn, tn, round(fp::DOUBLE / greatest(fp + tn, 1), 4) AS fpr FROM counts",
        "eval_report": _report(),
        "roc_auc": f"""WITH {PREDICTIONS} SELECT n_pos, n_neg, round((SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)
              FROM predictions p, predictions n WHERE p.label = 1 AND n.label = 0)::DOUBLE / (n_pos * n_neg), 6) AS auc
            FROM (SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM predictions)""",
        "scale_stats": over_messages("SELECT " + ", ".join(f"round(stddev_pop({c}), 6) AS {c}" for c in ("word_count", "unique_word_ratio", "uppercase_ratio")) + " FROM text_features"),
        "training_frame": f"""SELECT doc_id AS msg_id, toxic AS label, md5(trim(regexp_replace(' ' || text, '[\\x00{WS}]+', ' ', 'g'))) AS text_md5,
            len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9ıſ]+'), lambda w: w <> ''))::DOUBLE AS word_count,
            len(regexp_extract_all(text, '(?i)https?://\\S+|www\\.\\S+'))::DOUBLE AS url_count, 1.0::DOUBLE AS levenshtein_distance_to_brand
            FROM documents JOIN labels USING (doc_id)""",
        # streaming: the final state equals the batch result
        "stream_rate": rates,
        "stream_dedup": accepted(3600000, ">") + " SELECT event_id, user_id FROM fold WHERE accepted",
        "cooldown_hash": accepted_payload(7200000),
        "stream_cooldown_hash": accepted_payload(7200000),
        "stream_late": """WITH marks AS (SELECT event_type, lag(newest) OVER (ORDER BY event_type) - INTERVAL 10 DAY AS mark FROM (
              SELECT event_type, max(max(ts)) OVER (ORDER BY event_type) AS newest FROM events GROUP BY event_type))
            SELECT event_id, strftime(mark, '%Y-%m-%d %H:%M:%S.%g') AS watermark FROM events JOIN marks USING (event_type)
            WHERE time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= mark""",
        "stream_cooldown": accepted(7200000, ">=") + " SELECT event_id, accepted FROM fold",
        "stream_ttl": accepted(21600000, ">") + " SELECT event_id, NOT accepted AS is_hit FROM fold",
        "stream_feedback": f"WITH {FEEDBACK}, {FIRST_FEEDBACK} SELECT sample_hash, user_feedback, feedback_id, 'pending' AS review_status FROM first_ones",
        "stream_dashboard": over_events(f"""(SELECT 'classes' AS panel, classification AS item, count(*) AS n_events, round(avg(risk_score), 4) AS average_risk FROM risk_events GROUP BY 2)
            UNION ALL (SELECT 'trend', strftime(created_at, '%Y-%m-%d'), count(*), round(avg(risk_score), 4) FROM risk_events WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 2)
            UNION ALL (SELECT 'brands', impersonated_brand, count(*), round(avg(risk_score), 4) FROM risk_events WHERE impersonated_brand IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
            UNION ALL (SELECT 'recent', id::VARCHAR, 1, risk_score FROM risk_events ORDER BY created_at DESC, id DESC LIMIT 25)
            UNION ALL (SELECT 'feedback', feedback_id::VARCHAR, 1, current_risk_score FROM (WITH {FEEDBACK}, {FIRST_FEEDBACK} SELECT * FROM first_ones) ORDER BY created_at DESC, feedback_id DESC LIMIT 25)"""),
        "stream_export": over_events(f"SELECT 'alert' AS event_kind, {ISO} AS event_created, sample_hash AS msgrisk_sample_hash, risk_score AS msgrisk_risk_score FROM risk_events WHERE classification <> 'safe'"),
        "stream_assess": f"""WITH {DEMO_MESSAGES}, {canonical}, {TRIAGE}, {SCORES} SELECT msg_id AS id, sample_hash, sender_host AS domain, risk_score, classification, confidence, reasons
            FROM assessed JOIN hashed USING (msg_id)""",
    }
