"""Recognise private keys and signed tokens by the structure of what they decode to."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

# DER tags and prefixes of object identifiers (RFC 8017, 5958, 5915, 7292, 8018).
INTEGER, OCTETS, OID, SEQUENCE, EXPLICIT_0, EXPLICIT_1 = 0x02, 0x04, 0x06, 0x30, 0xA0, 0xA1
PKCS5, PKCS12_PBE = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")
PKCS7 = bytes.fromhex("2a864886f70d0107")
OPENSSH = b"openssh-key-v1\0"

Node = tuple[int, int, int]  # tag, start and end of the content


def node(data: bytes, at: int, end: int) -> Node | None:
    """The DER element at a place, if its length is written in the shortest way and stays inside `end`."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        if n < 0x80 or n >> (8 * (k - 1)) == 0:
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def inside(data: bytes, parent: Node) -> list[Node] | None:
    """The elements that fill a parent exactly, or None if they do not."""
    out, (_, at, end) = [], parent
    while at < end:
        child = node(data, at, end)
        if child is None:
            return None
        out.append(child)
        at = child[2]
    return out


def whole(data: bytes) -> Node | None:
    """The sequence that all of `data` is."""
    top = node(data, 0, len(data))
    return top if top and top[0] == SEQUENCE and top[2] == len(data) else None


def number(data: bytes, n: Node) -> int | None:
    return int.from_bytes(data[n[1] : n[2]], "big") if n[0] == INTEGER and 1 <= n[2] - n[1] <= 4 else None


def algorithm(data: bytes, n: Node) -> bytes | None:
    """The object identifier that an algorithm sequence opens with."""
    parts = inside(data, n) if n[0] == SEQUENCE else None
    return data[parts[0][1] : parts[0][2]] if parts and parts[0][0] == OID else None


def der_key(data: bytes) -> str | None:
    """What kind of private key a DER structure is; every nested length must hold."""
    top = whole(data)
    parts = inside(data, top) if top else None
    if not parts or len(parts) < 2:
        return None
    tags, first = [p[0] for p in parts], number(data, parts[0])
    if first == 0 and tags == [INTEGER] * 9:
        return "rsa"
    if first == 0 and tags == [INTEGER] * 6:
        return "dsa"
    if first == 1 and tags[1] == OCTETS and all(t in (EXPLICIT_0, EXPLICIT_1) for t in tags[2:]):
        return "ec" if all(inside(data, p) for p in parts[2:]) else None
    if first in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS] and algorithm(data, parts[1]):
        body = data[parts[2][1] : parts[2][2]]
        inner = node(body, 0, len(body))
        fits = inner is not None and inner[2] == len(body) and inner[0] in (SEQUENCE, OCTETS, INTEGER)
        return "pkcs8" if fits and (inner[0] != SEQUENCE or inside(body, inner)) else None
    if tags == [SEQUENCE, OCTETS]:
        kind = algorithm(data, parts[0])
        return "encrypted" if kind and kind.startswith((PKCS5, PKCS12_PBE)) else None
    if first == 3 and tags[1] == SEQUENCE:
        kind = algorithm(data, parts[1])
        return "pkcs12" if kind and kind.startswith(PKCS7) else None
    return None


def openssh_key(data: bytes) -> str | None:
    """'openssh' if the lengths of all fields lead exactly to the end."""
    if not data.startswith(OPENSSH):
        return None
    at = len(OPENSSH)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):  # cipher, derivation, its options
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    fine = 1 <= keys <= len(data) and all(field() for _ in range(keys)) and field()  # public keys, private part
    return "openssh" if fine and at == len(data) else None


def private_key(data: bytes) -> str | None:
    return openssh_key(data) or der_key(data)


def from_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if the text is neither."""
    bare = text.rstrip("=")
    if len(bare) % 4 == 1 or (len(bare) != len(text) and len(text) % 4):
        return None
    try:
        return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def from_hex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def json_object(data: bytes | None) -> dict | None:
    try:
        found = json.loads(data) if data and data.lstrip()[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(parts: list[str]) -> bool:
    """Whether dotted parts are a compact signed or encrypted token, by the header they open with."""
    head = json_object(from_base64(parts[0])) if len(parts) in (3, 5) else None
    if head is None or not isinstance(head.get("alg"), str):
        return False
    decoded = [from_base64(p) if p else b"" for p in parts[1:]]
    if None in decoded:
        return False
    if len(parts) == 5:
        return isinstance(head.get("enc"), str) and bool(decoded[2])
    return bool(decoded[0]) and (bool(decoded[1]) == (head["alg"].lower() != "none"))


def armor_body(body: str) -> Iterator[str]:
    """(headers, base64) of the inside of an armored block; line ends may be written as backslash letters."""
    lines = [line.strip() for line in body.replace("\\r", "\n").replace("\\n", "\n").split("\n")]
    yield "\n".join(line for line in lines if ":" in line)
    yield "".join(line.strip("\"'+, \t\r") for line in lines if ":" not in line)


def armored_key(label: str, body: str) -> bool:
    """Whether an armored block holds the kind of key that its label names."""
    headers, text = armor_body(body)
    data = from_base64(text)
    if not data:
        return False
    if "Proc-Type:" in headers and "ENCRYPTED" in headers:  # a whole number of cipher blocks
        return len(data) % 8 == 0
    found = private_key(data)
    wanted = {"RSA": {"rsa"}, "DSA": {"dsa"}, "EC": {"ec"}, "OPENSSH": {"openssh"}, "ENCRYPTED": {"encrypted"}, "": {"pkcs8"}}
    return found in wanted.get(label.removesuffix("PRIVATE KEY").strip(), {found} - {None})
