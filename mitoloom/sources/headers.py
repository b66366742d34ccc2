"""VCF headers as lists of lines: samples, contigs, declared fields, subsets."""

from __future__ import annotations

import re
from collections.abc import Sequence


class VcfHeader:
    """Header lines, the #CHROM line last. Methods that change it return a new header."""

    def __init__(self, lines: Sequence[str]):
        if not lines or not lines[-1].startswith("#CHROM"):
            raise ValueError("the last header line must be #CHROM")
        self.lines = list(lines)

    @property
    def samples(self) -> list[str]:
        return self.lines[-1].split("\t")[9:]

    @property
    def contigs(self) -> list[tuple[str, int | None]]:
        found = [re.search(r"^##contig=<ID=([^,>]+)(?:.*?length=(\d+))?", x) for x in self.lines]
        return [(m[1], int(m[2]) if m[2] else None) for m in found if m]

    def fields(self, kind: str) -> dict[str, tuple[str, str]]:
        """Number and Type by id of FORMAT or INFO."""
        found = [re.search(rf"^##{kind}=<ID=([^,>]+),Number=([^,>]+),Type=([^,>]+)", x) for x in self.lines]
        return {m[1]: (m[2], m[3]) for m in found if m}

    def index(self, sample: str) -> int:
        return self.samples.index(sample)

    def with_line(self, line: str) -> VcfHeader:
        return self if line in self.lines else VcfHeader([*self.lines[:-1], line, self.lines[-1]])

    def with_declared(self, line: str) -> VcfHeader:
        """The header with a line that declares a field, filter or contig, unless one of that kind and ID is there."""
        start = re.match(r"##\w+=<ID=[^,>]+", line)
        if start is None:
            return self.with_line(line)
        return self if any(re.match(re.escape(start[0]) + "[,>]", x) for x in self.lines) else VcfHeader([*self.lines[:-1], line, self.lines[-1]])

    def with_samples(self, samples: Sequence[str]) -> VcfHeader:
        """The samples in the order asked for; one that is not there, or comes twice, raises."""
        absent = [s for s in samples if s not in self.samples]
        if absent or len(set(samples)) < len(samples):
            raise ValueError(f"samples absent or repeated: {absent or list(samples)}")
        return VcfHeader([*self.lines[:-1], "\t".join([*self.lines[-1].split("\t")[:9], *samples])])

    def with_added(self, sample: str) -> VcfHeader:
        if sample in self.samples:
            raise ValueError(f"sample is there already: {sample}")
        return VcfHeader([*self.lines[:-1], "\t".join([*self.lines[-1].split("\t"), sample])])
