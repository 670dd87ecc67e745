"""External programs (prober, encoder, heavy repair models) behind one adapter, which says whether they are here."""

from __future__ import annotations

import os
import shutil
import subprocess
from dataclasses import dataclass
from itertools import product

from tessera.operators.engines import ModelUnavailable
from tessera.sources.encode import ENCODERS, HARDWARE


@dataclass(frozen=True)
class Tool:
    name: str
    timeout_s: float = 60

    def available(self) -> bool:
        return shutil.which(self.name) is not None

    def run(self, *args: str) -> bytes:
        """The program's output; ModelUnavailable where it is not installed."""
        if not self.available():
            raise ModelUnavailable(self.name)
        return subprocess.run([self.name, *args], check=True, capture_output=True, timeout=self.timeout_s).stdout

    def works(self, *args: str) -> bool:
        try:
            self.run(*args)
        except subprocess.SubprocessError:
            return False
        return True


PROBE, ENCODE, MEMORY = Tool("ffprobe"), Tool("ffmpeg", 3600), Tool("nvidia-smi", 5)
#: Quality arguments by the end of an encoder's name, q being the level; fixed values.
QUALITY = {
    "_nvenc": "-preset p5 -cq {q} -b:v 0", "_qsv": "-global_quality {q}", "_videotoolbox": "-q:v 65", "_amf": "-quality quality -qp_i {q} -qp_p {q}",
    "libx264": "-preset medium -crf {q}", "libx265": "-preset medium -crf {q}", "libsvtav1": "-preset 8 -crf {q}", "libaom-av1": "-cpu-used 6 -crf {q} -b:v 0",
}
LEVEL = {"h264": 19, "h265": 21, "av1": 28}
#: Audio encoders that each container takes, with their rate, in order of preference; fixed values.
AUDIO = {"webm": [("libopus", "160k"), ("opus", "160k"), ("aac", "192k")], "mp4": [("aac", "192k")], "matroska": [("aac", "192k"), ("libopus", "160k")]}
#: Further arguments by container.
CONTAINER = {"matroska": "-map 1:d? -map 1:t? -c:d copy -c:t copy", "mp4": "-movflags +faststart", "webm": ""}


def probe(path: str) -> str:
    """The JSON report that ``sources.probe.parse`` reads."""
    return PROBE.run("-v", "error", "-print_format", "json", "-show_format", "-show_streams", "-show_chapters", path).decode()


def available_encoders() -> set[str]:
    """Names of the encoders that the installed program lists."""
    lines = (line.split() for line in ENCODE.run("-hide_banner", "-encoders").decode().splitlines())
    return {x[1] for x in lines if len(x) > 1 and x[0][0] in "VAS"}


@dataclass(frozen=True)
class Attempt:
    """One way of encoding; cheaper, riskier ones sort first."""

    software: bool
    safe_audio: bool
    encoder: str
    audio: str
    rate: str | None

    def arguments(self, checkpoint: str, source: str, target: str, codec: str, family: str) -> list[str]:
        level = next(v for k, v in QUALITY.items() if self.encoder.endswith(k)).format(q=LEVEL[codec]).split()
        sound = ["-c:a", self.audio, *(["-b:a", self.rate] if self.rate else [])]
        return ["-y", "-v", "error", "-i", checkpoint, "-i", source, "-map", "0:v:0", "-map", "1:a?", "-map_metadata", "1", "-map_chapters", "1", "-c:v", self.encoder, *level, *sound, "-sn", *CONTAINER[family].split(), target]


def attempts(codec: str, family: str, here: set[str], audio: str = "copy") -> list[Attempt]:
    """The ways that are possible with the encoders ``here``: any or only software video, times the wanted or the container's safe audio.

    Each video and audio encoder pair comes once; the safe audio only with software video, as it is the last resort.
    """
    videos = {soft: next((e for e in ENCODERS[codec] if e in here and not (soft and e.endswith(HARDWARE))), None) for soft in (False, True)}
    sounds = {False: (audio, None), True: next(((a, r) for a, r in AUDIO[family] if a in here), (None, None))}
    every = [Attempt(soft, safe, videos[soft], *sounds[safe]) for soft, safe in product(videos, sounds) if videos[soft] and sounds[safe][0] and (soft or not safe)]
    first: dict[tuple[str, str], Attempt] = {}
    for one in sorted(every, key=lambda x: (x.safe_audio, x.software)):
        first.setdefault((one.encoder, one.audio), one)
    return list(first.values())


def encode(checkpoint: str, source: str, target: str, codec: str, family: str, audio: str = "copy", tool: Tool = ENCODE, here: set[str] | None = None) -> Attempt:
    """The first attempt that works. A target is only ever whole: each attempt writes beside it, and the good one is moved."""
    ways = attempts(codec, family, available_encoders() if here is None else here, audio)
    part = f"{target}.part{os.path.splitext(target)[1]}"
    good = next((a for a in ways if tool.works(*a.arguments(checkpoint, source, part, codec, family))), None)
    if good is None:
        raise RuntimeError(f"no way to encode {codec} into {family} worked: {[(a.encoder, a.audio) for a in ways]}")
    os.replace(part, target)
    return good


def device_memory(index: int = 0) -> tuple[str, int, int, int] | None:
    """(name, total, used, free) in MB of a GPU; None where there is none to ask."""
    if not MEMORY.available():
        return None
    try:
        line = MEMORY.run(f"--id={index}", "--query-gpu=name,memory.total,memory.used,memory.free", "--format=csv,noheader,nounits").decode()
    except subprocess.SubprocessError:
        return None
    name, *sizes = line.strip().rsplit(",", 3)
    return name.strip(), *map(int, sizes)
