"""Encrypted workbooks: the package within a compound file, decrypted by a password (agile and standard encryption)."""

from __future__ import annotations

import base64
import hashlib
import struct
from xml.etree import ElementTree

from ..table import session

#: Fixed values of the file formats.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF
_ENCRYPTION = "{http://schemas.microsoft.com/office/2006/encryption}"
_PASSWORD = "{http://schemas.microsoft.com/office/2006/keyEncryptor/password}"
_VERIFIER, _VERIFIER_HASH, _KEY = (bytes.fromhex(x) for x in ("fea7d2763b4b9e79", "d7aa0f6d3061344e", "146e0be7abacd0d6"))
_SEGMENT = 4096


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if data[:8] != MAGIC:
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    first_dir, = struct.unpack_from("<I", data, 48)
    cutoff, first_small, _, first_more, _ = struct.unpack_from("<5I", data, 56)
    size = 1 << shift
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw))
    sector = lambda i: data[(i + 1) * size : (i + 2) * size].ljust(size, b"\0")
    tables = [x for x in struct.unpack_from("<109I", data, 76) if x not in (_FREE, _END)]
    while first_more not in (_FREE, _END):
        *more, first_more = numbers(sector(first_more))
        tables += [x for x in more if x not in (_FREE, _END)]
    following = [n for t in tables for n in numbers(sector(t))]

    def chain(first: int, table: list[int]) -> list[int]:
        out = []
        while first not in (_END, _FREE):
            if first >= len(table) or len(out) > len(table):
                raise ValueError("a damaged compound file")
            out.append(first)
            first = table[first]
        return out

    whole = lambda first: b"".join(map(sector, chain(first, following)))
    entries = whole(first_dir)
    small_table = numbers(whole(first_small)) if first_small not in (_END, _FREE) else []
    found, small = {}, b""
    for at in range(0, len(entries) - 127, 128):
        kind, length = entries[at + 66], struct.unpack_from("<H", entries, at + 64)[0]
        first, n = struct.unpack_from("<IQ", entries, at + 116)
        n = n if shift > 9 else n & 0xFFFFFFFF
        name = entries[at : at + max(length - 2, 0)].decode("utf-16-le")
        if kind == 5:
            small = whole(first)
        elif kind == 2:
            unit = 1 << small_shift
            raw = whole(first) if n >= cutoff else b"".join(small[i * unit : (i + 1) * unit] for i in chain(first, small_table)) if n else b""
            found[name] = raw[:n]
    return found


def aes(key: bytes, data: bytes, iv: bytes | None, encrypt: bool = False) -> bytes:
    """AES without padding, in CBC or without iv in ECB mode, by the driver's JVM."""
    jvm = session()._jvm
    cipher = jvm.javax.crypto.Cipher.getInstance(f"AES/{'CBC' if iv else 'ECB'}/NoPadding")
    given = [jvm.javax.crypto.spec.SecretKeySpec(key, "AES"), *([jvm.javax.crypto.spec.IvParameterSpec(iv)] if iv else [])]
    cipher.init(1 if encrypt else 2, *given)
    return bytes(cipher.doFinal(data))


def spun(algorithm: str, salt: bytes, password: str, times: int) -> bytes:
    h = hashlib.new(algorithm, salt + password.encode("utf-16-le")).digest()
    for i in range(times):
        h = hashlib.new(algorithm, struct.pack("<I", i) + h).digest()
    return h


def fitted(raw: bytes, n: int) -> bytes:
    return raw[:n].ljust(n, b"\x36")


def _agile(info: bytes, package: bytes, password: str) -> bytes:
    root = ElementTree.fromstring(info)
    data, key = root.find(f"{_ENCRYPTION}keyData"), next(root.iter(f"{_PASSWORD}encryptedKey"))
    raw = lambda node, name: base64.b64decode(node.get(name))
    algorithm = key.get("hashAlgorithm").lower().replace("-", "")
    salt, bits = raw(key, "saltValue"), int(key.get("keyBits")) // 8
    h = spun(algorithm, salt, password, int(key.get("spinCount")))
    opened = lambda block, name: aes(fitted(hashlib.new(algorithm, h + block).digest(), bits), raw(key, name), fitted(salt, int(key.get("blockSize"))))
    verifier = opened(_VERIFIER, "encryptedVerifierHashInput")[: int(key.get("saltSize"))]
    hashed = hashlib.new(algorithm, verifier).digest()
    if opened(_VERIFIER_HASH, "encryptedVerifierHashValue")[: len(hashed)] != hashed:
        raise ValueError("excel: wrong password")
    secret = opened(_KEY, "encryptedKeyValue")[:bits]
    name, salt, block = data.get("hashAlgorithm").lower().replace("-", ""), raw(data, "saltValue"), int(data.get("blockSize"))
    out = []
    for i, at in enumerate(range(0, len(package), _SEGMENT)):
        part = package[at : at + _SEGMENT]
        out.append(aes(secret, part[: len(part) // 16 * 16], fitted(hashlib.new(name, salt + struct.pack("<I", i)).digest(), block)))
    return b"".join(out)


def _standard(info: bytes, package: bytes, password: str) -> bytes:
    size, = struct.unpack_from("<I", info, 4)
    bits, = struct.unpack_from("<I", info, 8 + 16)
    at = 8 + size
    n, = struct.unpack_from("<I", info, at)
    salt, verifier, hashed = info[at + 4 : at + 4 + n], info[at + 4 + n : at + 20 + n], info[at + 24 + n : at + 56 + n]
    h = hashlib.sha1(spun("sha1", salt, password, 50_000) + bytes(4)).digest()
    mixed = lambda c: hashlib.sha1(bytes(x ^ c for x in h.ljust(64, b"\0"))).digest()
    secret = (mixed(0x36) + mixed(0x5C))[: bits // 8]
    if aes(secret, hashed, None)[:20] != hashlib.sha1(aes(secret, verifier, None)).digest():
        raise ValueError("excel: wrong password")
    return aes(secret, package[: len(package) // 16 * 16], None)


def decrypted(data: bytes, password: str) -> bytes:
    """The workbook within an encrypted compound file."""
    found = streams(data)
    if "EncryptionInfo" not in found or "EncryptedPackage" not in found:
        raise ValueError("excel: not an encrypted workbook")
    info, package = found["EncryptionInfo"], found["EncryptedPackage"]
    size, = struct.unpack_from("<Q", package)
    major, minor = struct.unpack_from("<HH", info)
    if (major, minor) == (4, 4):
        return _agile(info[8:], package[8:], password)[:size]
    if minor == 2 and major in (2, 3, 4):
        return _standard(info[4:], package[8:], password)[:size]
    raise NotImplementedError(f"excel: encryption {major}.{minor}")
