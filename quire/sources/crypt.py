"""Standard security handler: keys for the empty user password, and stream decryption."""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache

import numpy as np

from .syntax import Name

#: The password padding, and the salt of AES object keys.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
SALT = b"sAlT"


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """A product in the field of AES."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@cache
def _boxes() -> tuple[bytes, bytes]:
    """The substitution box, from inverses in the field, and its inverse."""
    power, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x = _times(x, 3)
    box = bytearray(256)
    for v in range(256):
        inv = power[(255 - log[v]) % 255] if v else 0
        box[v] = 0x63 ^ inv ^ _turn(inv, 1) ^ _turn(inv, 2) ^ _turn(inv, 3) ^ _turn(inv, 4)
    back = bytearray(256)
    for v in range(256):
        back[box[v]] = v
    return bytes(box), bytes(back)


def _turn(v: int, n: int) -> int:
    return (v << n | v >> (8 - n)) & 255


@cache
def _products(by: int) -> bytes:
    return bytes(_times(v, by) for v in range(256))


@lru_cache(64)
def _schedule(key: bytes) -> list[bytes]:
    box, n, words = _boxes()[0], len(key) // 4, [key[i : i + 4] for i in range(0, len(key), 4)]
    round_constant = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(box[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ round_constant]) + w[1:]
            round_constant = _times(round_constant, 2)
        elif n > 6 and i % n == 4:
            w = bytes(box[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


_SHIFT = [0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11]
_UNSHIFT = [_SHIFT.index(i) for i in range(16)]


def _columns(state: bytes, factors: tuple[int, int, int, int]) -> bytes:
    tables = [_products(f) for f in factors]
    out = bytearray(16)
    for c in range(0, 16, 4):
        for r in range(4):
            out[c + r] = tables[0][state[c + r]] ^ tables[1][state[c + (r + 1) % 4]] ^ tables[2][state[c + (r + 2) % 4]] ^ tables[3][state[c + (r + 3) % 4]]
    return bytes(out)


@cache
def _added() -> tuple[list[list[int]], list[list[int]]]:
    """What each byte of a state, by its place and value, adds to the state after a round, and after the last one.

    A round is linear but for its box, so it is the sum of what 16 bytes add; states are numbers of 128 bits."""
    rounds, last = [], []
    for i in range(16):
        moved = [bytes(v if j == i else 0 for j in _SHIFT) for v in _boxes()[0]]
        last.append([int.from_bytes(m, "big") for m in moved])
        rounds.append([int.from_bytes(_columns(m, (2, 3, 1, 1)), "big") for m in moved])
    return rounds, last


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding; each block needs the one before."""
    first, *keys = [int.from_bytes(k, "big") for k in _schedule(key)]
    rounds, last = _added()
    steps, out, state = [*((k, rounds) for k in keys[:-1]), (keys[-1], last)], [], int.from_bytes(iv, "big")
    for i in range(0, len(data), 16):
        state ^= int.from_bytes(data[i : i + 16], "big") ^ first
        for k, added in steps:
            before, state = state.to_bytes(16, "big"), k
            for table, v in zip(added, before):  # noqa: B905 (both have 16 items; a check costs time)
                state ^= table[v]
        out.append(state.to_bytes(16, "big"))
    return b"".join(out)


def aes_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC, padding left on; all blocks at once, a part of a block at the end is left out."""
    keys = [np.frombuffer(k, np.uint8) for k in _schedule(key)]
    back, products = (np.frombuffer(x, np.uint8) for x in (_boxes()[1], b"".join(map(_products, (14, 11, 13, 9)))))
    products = products.reshape(4, 256)
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    state = blocks
    for k in keys[:0:-1]:
        state = state ^ k
        if k is not keys[-1]:
            columns, state = state.reshape(-1, 4, 4), 0
            for turn, table in enumerate(products):
                state = state ^ table[np.roll(columns, -turn, 2)]
            state = state.reshape(-1, 16)
        state = back[state[:, _UNSHIFT]]
    before = np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), blocks[:-1]]) if len(blocks) else blocks
    return (state ^ keys[0] ^ before).tobytes()


@lru_cache(256)  # a file is opened for each of its tables
def hash_v5(salt: bytes, revision: int, password: bytes = b"", extra: bytes = b"") -> bytes:
    k = hashlib.sha256(password + salt + extra).digest()
    done = 0
    while revision == 6:
        k1 = aes_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(k1[:16]) % 3](k1).digest()
        done += 1
        if done >= 64 and k1[-1] <= done - 32:
            break
    return k[:32]


class Crypt:
    """Keys of a file. method: rc4, aes128, aes256, or None if the handler is not supported."""

    def __init__(self, encrypt: dict, first_id: bytes):
        self.method, self.key = None, b""
        if encrypt.get("Filter", Name("Standard")) != "Standard":
            return
        v, r = encrypt.get("V", 0), encrypt.get("R", 0)
        if v == 5 and r in (5, 6):
            self._v5(encrypt, r)
            return
        if (v, r) not in ((1, 2), (1, 3), (2, 2), (2, 3), (4, 4)):
            return
        size, method = min(16, max(5, encrypt.get("Length", 40) // 8)), "rc4"
        if v == 4:
            named = (encrypt.get("CF") or {}).get(str(encrypt.get("StmF", "StdCF"))) or {}
            if named.get("CFM") == "AESV2":
                size, method = 16, "aes128"
            elif named.get("CFM") != "V2":
                return
        owner = encrypt.get("O")
        if not isinstance(owner, bytes) or len(owner) < 32:
            return
        seed = PAD + owner[:32] + (encrypt.get("P", 0) & 0xFFFFFFFF).to_bytes(4, "little") + first_id
        if r >= 4 and encrypt.get("EncryptMetadata") is False:
            seed += b"\xff" * 4
        digest = hashlib.md5(seed).digest()
        if r >= 3:
            for _ in range(50):
                digest = hashlib.md5(digest[:size]).digest()
        self.method, self.key = method, digest[:size]

    def _v5(self, encrypt: dict, revision: int) -> None:
        user, wrapped = encrypt.get("U"), encrypt.get("UE")
        if not isinstance(user, bytes) or not isinstance(wrapped, bytes) or len(user) < 48 or len(wrapped) < 32:
            return
        if hash_v5(user[32:40], revision) != user[:32]:
            return
        self.method, self.key = "aes256", aes_decrypt(hash_v5(user[40:48], revision), bytes(16), wrapped[:32])

    def object_key(self, num: int, gen: int) -> bytes:
        if self.method == "aes256":
            return self.key
        seed = self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (SALT if self.method == "aes128" else b"")
        return hashlib.md5(seed).digest()[: min(16, len(self.key) + 5)]

    def decrypt(self, num: int, gen: int, data: bytes) -> bytes:
        """A stream's bytes. Data that cannot be AES is given back as far as it goes."""
        if not self.method or not data:
            return data
        key = self.object_key(num, gen)
        if self.method == "rc4":
            return rc4(key, data)
        if len(data) < 32:
            return b""
        if len(data) % 16:
            return data[: len(data) - 16]
        out = aes_decrypt(key, data[:16], data[16:])
        pad = out[-1]
        return out[:-pad] if 1 <= pad <= 16 else out
