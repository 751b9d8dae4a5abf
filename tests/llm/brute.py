"""Plain Python versions of what the operators return, for small inputs."""

import base64
import hashlib
import re

import public_tokenizers
import tiktoken

SECRET = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, fits in (("card", r"[0-9]([\x20-]?[0-9])+", lambda d: 13 <= len(d) <= 19 and luhn(d)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda d: 9 <= len(d) <= 15)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if fits(re.sub("[^0-9]", "", m[0]))]
    return out


def secret(text):
    out = [("assign", *m.span()) for m in SECRET.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def written(spans):
    return ",".join(":".join(map(str, s)) for s in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library():
    """The tokenizer that ids must equal."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.read().splitlines())}
    return tiktoken.Encoding("held", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
