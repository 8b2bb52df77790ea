"""Encrypted workbooks: written here by the formats' rules, read by the reader."""

import base64
import hashlib
import os
import struct

import pytest

from tabloom.catalog_api import workbook
from tabloom.sources import encrypted
from tabloom.sources.workbook import ExcelReader, sheet_names

pytestmark = pytest.mark.usefixtures("spark")


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; streams of less than 4096 bytes stand in the small stream."""
    unit, end, free = 512, 0xFFFFFFFE, 0xFFFFFFFF
    sectors, table, small, small_table, entries = [], [], b"", [], []

    def add(raw: bytes) -> int:
        first, n = len(sectors), -(-len(raw) // unit)
        for i in range(n):
            sectors.append(raw[i * unit : (i + 1) * unit].ljust(unit, b"\0"))
            table.append(first + i + 1 if i < n - 1 else end)
        return first if n else end

    def entry(name, kind, first, size, child=free, right=free) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, free, right, child) + bytes(36) + struct.pack("<IQ", first, size)

    for name, raw in streams.items():
        if len(raw) >= 4096:
            entries.append((name, add(raw), len(raw)))
            continue
        n, first = -(-len(raw) // 64), len(small_table)
        small_table += [first + i + 1 if i < n - 1 else end for i in range(n)]
        small += raw.ljust(n * 64, b"\0")
        entries.append((name, first, len(raw)))
    small_first = add(small)
    names = [entry("Root Entry", 5, small_first, len(small), child=1)]
    names += [entry(n, 2, f, s, right=i + 2 if i + 1 < len(entries) else free) for i, (n, f, s) in enumerate(entries)]
    directory = add(b"".join(names))
    small_fat = add(struct.pack(f"<{len(small_table)}I", *small_table).ljust(unit, b"\xff"))
    fat_at = len(sectors)
    table.append(0xFFFFFFFD)
    assert len(table) <= 128
    sectors.append(struct.pack(f"<{len(table)}I", *table).ljust(unit, b"\xff"))
    head = encrypted.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIII", 0, 1, directory, 0) + struct.pack("<IIIII", 4096, small_fat, 1, end, 0)
    return head + struct.pack("<109I", fat_at, *[free] * 108) + b"".join(sectors)


def padded(raw: bytes, n: int = 16) -> bytes:
    return raw.ljust(-(-len(raw) // n) * n, b"\0")


def agile(data: bytes, password: str) -> bytes:
    salt, key_salt, secret, verifier = (os.urandom(n) for n in (16, 16, 32, 16))
    text = lambda raw: base64.b64encode(raw).decode()
    h = encrypted.spun("sha512", salt, password, 1000)
    closed = lambda block, raw: text(encrypted.aes(hashlib.sha512(h + bytes.fromhex(block)).digest()[:32], padded(raw), salt, True))
    common = 'saltSize="16" blockSize="16" keyBits="256" hashSize="64" cipherAlgorithm="AES" cipherChaining="ChainingModeCBC" hashAlgorithm="SHA512"'
    info = (
        '<encryption xmlns="http://schemas.microsoft.com/office/2006/encryption" xmlns:p="http://schemas.microsoft.com/office/2006/keyEncryptor/password">'
        f'<keyData {common} saltValue="{text(key_salt)}"/><keyEncryptors><keyEncryptor uri="http://schemas.microsoft.com/office/2006/keyEncryptor/password">'
        f'<p:encryptedKey spinCount="1000" {common} saltValue="{text(salt)}" encryptedVerifierHashInput="{closed("fea7d2763b4b9e79", verifier)}" '
        f'encryptedVerifierHashValue="{closed("d7aa0f6d3061344e", hashlib.sha512(verifier).digest())}" encryptedKeyValue="{closed("146e0be7abacd0d6", secret)}"/></keyEncryptor></keyEncryptors></encryption>'
    )
    parts = [encrypted.aes(secret, padded(data[at : at + 4096]), hashlib.sha512(key_salt + struct.pack("<I", i)).digest()[:16], True) for i, at in enumerate(range(0, len(data), 4096))]
    return compound({"EncryptionInfo": struct.pack("<HHI", 4, 4, 0x40) + info.encode(), "EncryptedPackage": struct.pack("<Q", len(data)) + b"".join(parts)})


def standard(data: bytes, password: str) -> bytes:
    salt, verifier = os.urandom(16), os.urandom(16)
    h = hashlib.sha1(encrypted.spun("sha1", salt, password, 50_000) + bytes(4)).digest()
    secret = hashlib.sha1(bytes(x ^ 0x36 for x in h.ljust(64, b"\0"))).digest()[:16]
    header = struct.pack("<8I", 0x24, 0, 0x660E, 0x8004, 128, 0x18, 0, 0) + "AES".encode("utf-16-le") + b"\0\0"
    info = struct.pack("<HHII", 3, 2, 0x24, len(header)) + header + struct.pack("<I", 16) + salt + encrypted.aes(secret, verifier, None, True) + struct.pack("<I", 20) + encrypted.aes(secret, padded(hashlib.sha1(verifier).digest()), None, True)
    return compound({"EncryptionInfo": info, "EncryptedPackage": struct.pack("<Q", len(data)) + encrypted.aes(secret, padded(data), None, True)})


@pytest.mark.parametrize("close", [agile, standard])
def test_encrypted_workbooks_open_by_their_password(close, tmp_path):
    rows = [["id", "name"], *([str(i), f"row {i} of {close.__name__}"] for i in range(200))]
    data = close(workbook({"one": rows, "two": [["a"], ["b"]]}), "pass wörd")
    path = f"file://{tmp_path}/book.xlsx"
    (tmp_path / "book.xlsx").write_bytes(data)
    assert ExcelReader(password="pass wörd").read_file(path).unwrap().records() == rows[1:]
    assert ExcelReader(password="pass wörd", sheet="two").read_bytes(data).unwrap().records() == [["b"]]
    assert sheet_names(data, "pass wörd") == ["one", "two"]
    assert "password" in str(ExcelReader(password="other").read_file(path).error)
    assert "password" in str(ExcelReader().read_file(path).error)


def test_plain_and_damaged_files(spark):
    plain = workbook({"one": [["a"], ["b"]]})
    assert ExcelReader(password="not needed").read_bytes(plain).unwrap().records() == [["b"]]
    assert ExcelReader(password="x").read_bytes(encrypted.MAGIC + bytes(600)).is_err()
    assert ExcelReader(password="x").read_bytes(compound({"Other": b"x" * 5000})).is_err()
