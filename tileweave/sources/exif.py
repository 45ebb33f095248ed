"""EXIF tags as rows, from content in a column or from the ranges of a file that hold them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.numeric import as_col
from .ranges import Content, FileRanges, Slices, as_content, boxes, meta_box

TAG_SCHEMA = "path string, ifd string, tag string, value string, seq bigint, error string, display string"

# Tag numbers of the Exif 2.3 standard, per directory.
TIFF_TAGS = {
    0x00FE: "NewSubfileType", 0x00FF: "SubfileType", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample",
    0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010D: "DocumentName", 0x010E: "ImageDescription",
    0x010F: "Make", 0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel",
    0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution",
    0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit", 0x012D: "TransferFunction", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities",
    0x0142: "TileWidth", 0x0143: "TileLength", 0x0144: "TileOffsets", 0x0145: "TileByteCounts",
    0x0201: "JPEGInterchangeFormat", 0x0202: "JPEGInterchangeFormatLength", 0x0211: "YCbCrCoefficients",
    0x0212: "YCbCrSubSampling", 0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite", 0x8298: "Copyright",
}
EXIF_TAGS = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8824: "SpectralSensitivity",
    0x8827: "PhotographicSensitivity", 0x8828: "OECF", 0x8830: "SensitivityType", 0x8831: "StandardOutputSensitivity",
    0x8832: "RecommendedExposureIndex", 0x8833: "ISOSpeed", 0x8834: "ISOSpeedLatitudeyyy", 0x8835: "ISOSpeedLatitudezzz",
    0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime",
    0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9101: "ComponentsConfiguration",
    0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue",
    0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode",
    0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea", 0x927C: "MakerNote",
    0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized",
    0x9400: "Temperature", 0x9401: "Humidity", 0x9402: "Pressure", 0x9403: "WaterDepth", 0x9404: "Acceleration",
    0x9405: "CameraElevationAngle", 0xA000: "FlashpixVersion", 0xA001: "ColorSpace", 0xA002: "PixelXDimension",
    0xA003: "PixelYDimension", 0xA004: "RelatedSoundFile", 0xA20B: "FlashEnergy", 0xA20C: "SpatialFrequencyResponse",
    0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit",
    0xA214: "SubjectLocation", 0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource",
    0xA301: "SceneType", 0xA302: "CFAPattern", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance",
    0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl",
    0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA40B: "DeviceSettingDescription",
    0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber",
    0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber", 0xA500: "Gamma",
}
GPS_TAGS = {
    0x0000: "GPSVersionID", 0x0001: "GPSLatitudeRef", 0x0002: "GPSLatitude", 0x0003: "GPSLongitudeRef",
    0x0004: "GPSLongitude", 0x0005: "GPSAltitudeRef", 0x0006: "GPSAltitude", 0x0007: "GPSTimeStamp",
    0x0008: "GPSSatellites", 0x0009: "GPSStatus", 0x000A: "GPSMeasureMode", 0x000B: "GPSDOP", 0x000C: "GPSSpeedRef",
    0x000D: "GPSSpeed", 0x000E: "GPSTrackRef", 0x000F: "GPSTrack", 0x0010: "GPSImgDirectionRef", 0x0011: "GPSImgDirection",
    0x0012: "GPSMapDatum", 0x0013: "GPSDestLatitudeRef", 0x0014: "GPSDestLatitude", 0x0015: "GPSDestLongitudeRef",
    0x0016: "GPSDestLongitude", 0x0017: "GPSDestBearingRef", 0x0018: "GPSDestBearing", 0x0019: "GPSDestDistanceRef",
    0x001A: "GPSDestDistance", 0x001B: "GPSProcessingMethod", 0x001C: "GPSAreaInformation", 0x001D: "GPSDateStamp",
    0x001E: "GPSDifferential", 0x001F: "GPSHPositioningError",
}
INTEROP_TAGS = {0x0001: "InteroperabilityIndex", 0x0002: "InteroperabilityVersion"}
EXIF_POINTER, GPS_POINTER, INTEROP_POINTER = 0x8769, 0x8825, 0xA005
# Field type to (struct code, size); 5 and 10 are pairs.
FIELD_TYPES = {
    1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1),
    8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8),
}
# Units after, signs before a number.
UNITS = {
    "ExposureTime": "s", "ShutterSpeedValue": "EV", "ApertureValue": "EV", "BrightnessValue": "EV", "ExposureBiasValue": "EV",
    "MaxApertureValue": "EV", "SubjectDistance": "m", "FocalLength": "mm", "FocalLengthIn35mmFilm": "mm", "Temperature": "degC",
    "Humidity": "%", "Pressure": "hPa", "WaterDepth": "m", "Acceleration": "mGal", "CameraElevationAngle": "deg",
    "FlashEnergy": "BCPS", "PixelXDimension": "pixels", "PixelYDimension": "pixels", "ImageWidth": "pixels",
    "ImageLength": "pixels", "GPSHPositioningError": "m",
}
PREFIXES = {"FNumber": "f/"}
# Meanings of coded values.
MEANINGS = {
    "Orientation": {
        "1": "row 0 at top and column 0 at left", "2": "row 0 at top and column 0 at right", "3": "row 0 at bottom and column 0 at right",
        "4": "row 0 at bottom and column 0 at left", "5": "row 0 at left and column 0 at top", "6": "row 0 at right and column 0 at top",
        "7": "row 0 at right and column 0 at bottom", "8": "row 0 at left and column 0 at bottom",
    },
    "ResolutionUnit": {"1": "no absolute unit", "2": "inch", "3": "cm"},
    "ExposureProgram": {
        "0": "not defined", "1": "manual", "2": "normal program", "3": "aperture priority", "4": "shutter priority",
        "5": "creative program", "6": "action program", "7": "portrait mode", "8": "landscape mode",
    },
    "MeteringMode": {
        "0": "unknown", "1": "average", "2": "center-weighted average", "3": "spot", "4": "multi-spot", "5": "pattern",
        "6": "partial", "255": "other",
    },
    "ExposureMode": {"0": "auto exposure", "1": "manual exposure", "2": "auto bracket"},
    "WhiteBalance": {"0": "auto white balance", "1": "manual white balance"},
    "ColorSpace": {"1": "sRGB", "65535": "uncalibrated"},
    "SceneCaptureType": {"0": "standard", "1": "landscape", "2": "portrait", "3": "night scene"},
    "GPSAltitudeRef": {"0": "above sea level", "1": "below sea level"},
}
#: Tags whose unit or sense another tag of the file names.
_REFERENCES = {
    "GPSLatitude": "GPSLatitudeRef", "GPSLongitude": "GPSLongitudeRef", "GPSDestLatitude": "GPSDestLatitudeRef",
    "GPSDestLongitude": "GPSDestLongitudeRef", "GPSAltitude": "GPSAltitudeRef", "XResolution": "ResolutionUnit",
    "YResolution": "ResolutionUnit", "FocalPlaneXResolution": "FocalPlaneResolutionUnit", "FocalPlaneYResolution": "FocalPlaneResolutionUnit",
    "GPSSpeed": "GPSSpeedRef", "GPSDestDistance": "GPSDestDistanceRef",
}
_SPEEDS, _DISTANCES = {"K": "km/h", "M": "mph", "N": "knots"}, {"K": "km", "M": "miles", "N": "nautical miles"}


def _item_extents(d: Content, meta: tuple[int, int]) -> list[tuple[int, int]] | None:
    """Where the bytes of the ``Exif`` item are, by the item tree: ``iinf`` names it, ``iloc`` places it."""
    wanted, data_at, location = None, None, None
    for kind, body, end in boxes(d, *meta):
        if kind == b"iinf":
            first = body + (6 if d.number(body, 1) == 0 else 8)
            for name, at, _ in boxes(d, first, end):
                version = d.number(at, 1) if name == b"infe" else 0
                wide = {2: 2, 3: 4}.get(version)
                if wide and d.get(at + 6 + wide, 4) == b"Exif" and wanted is None:
                    wanted = d.number(at + 4, wide)
        elif kind == b"iloc":
            location = body
        elif kind == b"idat":
            data_at = body
    if wanted is None or location is None:
        return None
    version, sizes = d.number(location, 1), d.number(location + 4, 2)
    offset_size, length_size, base_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15
    index_size = sizes & 15 if version else 0
    wide, at = (4, location + 6) if version == 2 else (2, location + 6)
    count, at = d.number(at, wide), at + wide

    def number(size: int) -> int:
        nonlocal at
        value, at = (d.number(at, size) if size else 0), at + size
        return value

    for _ in range(count):
        item = number(wide)
        method = number(2) & 15 if version else 0
        number(2)
        base, extents = number(base_size), []
        for _ in range(number(2)):
            number(index_size)
            extents.append((base + number(offset_size), number(length_size)))
        if item == wanted:
            if method == 1 and data_at is not None:
                return [(data_at + at_, size) for at_, size in extents]
            # A length of 0 means all up to the end of the file.
            return [(at_, size or d.length - at_) for at_, size in extents] if method == 0 else None
    return None


def _from_boxes(d: Content) -> Content | None:
    meta = meta_box(d)
    if meta is None:
        # No item tree to ask.
        at = d.find(rb"Exif\0\0(?:II\*\0|MM\0\*)")
        return Slices(d, [(at + 6, d.length - at - 6)]) if at >= 0 else None
    extents = _item_extents(d, meta)
    if extents is None:
        return None
    item = Slices(d, extents)
    start = 4 + item.number(0, 4)
    # Some writers count from a marker that they put before the header.
    marked = item.some(start, 6) == b"Exif\0\0"
    start += 6 if marked else 0
    return Slices(item, [(start, item.length - start)])


def exif_block(data) -> Content | None:
    """The TIFF-structured part of a JPEG, PNG, WebP, HEIF/AVIF or TIFF file; None if there is none."""
    d = as_content(data)
    head = d.some(0, 12)
    if head[:4] in (b"II*\0", b"MM\0*"):
        return d
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= d.length and (mark := d.get(at, 4))[0] == 0xFF and mark[1] != 0xDA:
            size = int.from_bytes(mark[2:], "big")
            if mark[1] == 0xE1 and d.some(at + 4, 6) == b"Exif\0\0":
                return Slices(d, [(at + 10, min(size - 8, d.length - at - 10))])
            at += 2 + max(size, 2)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= d.length:
            size = d.number(at, 4)
            if d.get(at + 4, 4) == b"eXIf":
                return Slices(d, [(at + 8, min(size, d.length - at - 8))])
            at += 12 + size
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        at = 12
        while at + 8 <= d.length:
            size = d.number(at + 4, 4, "little")
            if d.get(at, 4) == b"EXIF":
                skip = 6 if d.some(at + 8, 6) == b"Exif\0\0" else 0
                return Slices(d, [(at + 8 + skip, min(size, d.length - at - 8) - skip)])
            at += 8 + size + size % 2
    if head[4:8] == b"ftyp":
        return _from_boxes(d)
    return None


def _value(block: Content, order: str, kind: int, count: int, slot: int) -> list | str | None:
    code, size = FIELD_TYPES.get(kind, (None, 0))
    if code is None:
        return None
    at = slot if size * count <= 4 else struct.unpack(order + "I", block.get(slot, 4))[0]
    raw = block.some(at, size * count)
    if len(raw) < size * count:
        raise ValueError("truncated field")
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    numbers = struct.unpack(f"{order}{code * count}", raw)
    if kind in (5, 10):
        return [f"{a}/{b}" for a, b in zip(numbers[::2], numbers[1::2])]
    return list(numbers)


def tags_of(data) -> list[tuple[str, str, str]]:
    """``(ifd, tag, value)`` in file order. The first directory and those it points to are primary."""
    block = exif_block(data)
    if block is None:
        return []
    order = {b"II": "<", b"MM": ">"}.get(block.some(0, 2))
    if order is None:
        return []
    out: list[tuple[str, str, str]] = []
    todo = [(struct.unpack(order + "I", block.get(4, 4))[0], "primary", TIFF_TAGS, True)]
    seen: set[int] = set()
    pointers = {EXIF_POINTER: EXIF_TAGS, GPS_POINTER: GPS_TAGS, INTEROP_POINTER: INTEROP_TAGS}
    while todo:
        at, ifd, names, chained = todo.pop(0)
        if at == 0 or at in seen:
            continue
        seen.add(at)
        (entries,) = struct.unpack(order + "H", block.get(at, 2))
        for i in range(entries):
            slot = at + 2 + 12 * i
            tag, kind, count = struct.unpack(order + "HHI", block.get(slot, 8))
            if tag in pointers:
                todo.append((struct.unpack(order + "I", block.get(slot + 8, 4))[0], ifd, pointers[tag], False))
                continue
            value = _value(block, order, kind, count, slot + 8)
            if value is not None:
                text = value if isinstance(value, str) else ", ".join(map(str, value))
                out.append((ifd, names.get(tag, f"0x{tag:04X}"), text))
        if chained:
            todo.append((struct.unpack(order + "I", block.get(at + 2 + 12 * entries, 4))[0], "thumbnail", TIFF_TAGS, False))
    return out


def _decimal(part: str) -> str:
    """A rational as a decimal number of at most six places; a part of 0 stays as it is."""
    up, _, down = part.partition("/")
    if not down:
        return part
    return f"{int(up) / int(down):.6f}".rstrip("0").rstrip(".") if int(down) else part


def displayed(tags: list[tuple[str, str, str]]) -> list[str]:
    """Each value as a reader wants it: decimals with units, meanings of codes, coordinates with their direction."""
    known = {(ifd, tag): value for ifd, tag, value in tags}
    out = []
    for ifd, tag, value in tags:
        parts = value.split(", ")
        reference = known.get((ifd, _REFERENCES.get(tag)))
        if value in MEANINGS.get(tag, {}):
            text = MEANINGS[tag][value]
        elif tag == "ExposureTime" and value.startswith("1/"):
            text = value
        elif tag in ("GPSLatitude", "GPSLongitude", "GPSDestLatitude", "GPSDestLongitude") and len(parts) == 3:
            text = " ".join(f"{_decimal(p)} {unit}" for p, unit in zip(parts, ("deg", "min", "sec")))
        elif tag == "GPSTimeStamp" and len(parts) == 3:
            text = ":".join(_decimal(p).zfill(2) for p in parts) + " UTC"
        else:
            text = ", ".join(map(_decimal, parts)) if "/" in value and all(p.replace("/", "").replace("-", "").isdigit() for p in parts) else value
        if tag in ("XResolution", "YResolution", "FocalPlaneXResolution", "FocalPlaneYResolution"):
            text += {"2": " pixels per inch", "3": " pixels per cm"}.get(reference, "")
        elif tag == "GPSAltitude":
            text += " m" + (f" {MEANINGS['GPSAltitudeRef'][reference]}" if reference in ("0", "1") else "")
        elif tag in ("GPSSpeed", "GPSDestDistance"):
            text += f" {(_SPEEDS if tag == 'GPSSpeed' else _DISTANCES).get(reference, '')}".rstrip()
        elif reference and tag.startswith("GPS"):
            text += f" {reference}"
        text = PREFIXES.get(tag, "") + text + (f" {UNITS[tag]}" if tag in UNITS else "")
        out.append(text)
    return out


def _rows(path: str, source) -> list[tuple]:
    tags = tags_of(source)
    return [(path, *t, i, None, text) for i, (t, text) in enumerate(zip(tags, displayed(tags)))]


def exif_tags(files: DataFrame, path="path", content="content") -> DataFrame:
    """One row per tag. No EXIF means no rows; a broken block gives one row with ``error`` set.

    With ``content=None`` tasks open the files of ``path`` and read only the ranges that hold tags and the markers
    before them. ``display`` is the value with its unit.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"] if content is not None else batch["path"]):
                try:
                    if content is not None:
                        rows += _rows(name, bytes(data))
                    else:
                        with FileRanges(data) as ranges:
                            rows += _rows(name, ranges)
                except Exception as error:
                    rows.append((name, None, None, None, 0, f"exif: {error}", None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TAG_SCHEMA.split(", ")])

    columns = [as_col(path).alias("path")] + ([as_col(content).alias("content")] if content is not None else [])
    return files.select(*columns).mapInPandas(parse, TAG_SCHEMA)
