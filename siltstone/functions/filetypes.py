"""What a file's name and size say: tables of extensions, and the rules that go by them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB = 1 << 10, 1 << 20

#: Extensions of each category of the statistics.
CATEGORIES = {
    "video": "mp4 mov avi mkv webm flv wmv m4v mxf r3d",
    "audio": "wav aiff aif mp3 flac ogg m4a aac opus",
    "image": "jpg jpeg png tif tiff bmp webp heic raw dng cr2 nef arw",
    "creative": "psd psb ai ait indd idml eps pdf xd",
    "3d": "glb gltf fbx obj blend ma mb abc usd usda usdc usdz stl ply",
    "office": "docx xlsx pptx doc xls ppt odt ods odp",
}
#: Extensions by which a merge chooses how to read a file.
MEDIA_TYPES = {
    "image": "jpg jpeg png gif bmp tiff tif webp svg raw cr2 cr3 nef arw dng orf rw2 pef srw heic heif exr hdr avif jxl",
    "psd": "psd psb xcf kra ora",
    "video": "mp4 mov avi mkv webm flv wmv m4v 3gp 3g2 mpg mpeg mts m2ts vob ts mxf r3d braw ari",
    "audio": "mp3 wav flac aac ogg m4a wma aiff aif opus alac ape dsd dsf dff mid midi",
    "model3d": "obj fbx gltf glb stl dae 3ds ply usd usda usdc usdz abc blend max ma mb c4d hip hiplc hipnc zpr ztl",
    "vfx": "indd indt ai ait aep aet prproj mogrt sesx pdf pproj drp fcpxml fcpbundle nk nknc comp aaf omf edl fig sketch xd",
}
#: Endings of names by which files are counted as media or text.
FILE_CLASSES = {
    "media": "mp4 mov avi mkv mp3 wav flac aac jpg jpeg png gif webp psd tiff raw blend fbx obj gltf",
    "text": "txt md json yaml yml toml xml csv rs py js ts html css",
}
#: How a file of an extension is compressed; all others by Zstandard at its default level.
STRATEGIES = {
    "store": "jpg jpeg png gif webp avif heic heif dds ktx ktx2 astc pvr basis mp4 m4v mov qt avi mkv mk3d webm mka flv f4v wmv asf mpg mpeg m2v mxf m2ts vob m2p 3gp 3g2 3gpp 3gpp2 rm rmvb rv "
    "mp3 aac m4a m4b m4r ogg oga opus wma amr awb zip zipx gz gzip 7z rar bz2 bzip2 xz lzma lz4 zst zstd lz z br whl egg apk ipa aab jar war ear crx xpi usdz parquet arrow feather orc avro "
    "ai ait indd idml indt docx doc docm dot dotx xlsx xls xlsm xlsb xlt xltx pptx ppt pptm pot potx odt ods odp odg odf",
    "zstd-best": "tif tiff bmp dib raw cr2 cr3 nef arw dng orf rw2 braw r3d ari arriraw cine crm exr hdr pic dpx flac wav aiff aif aifc alac ape wv wvp stl obj fbx glb gltf ply dae abc 3ds usd usda usdc",
    "brotli": "txt md markdown rst adoc rs js ts jsx tsx py go c cpp cc cxx h hpp hh hxx java kt swift rb php sh bash zsh fish vim lua pl r m json json5 jsonc xml html xhtml htm xsl xslt yml yaml toml csv tsv psv",
    "zstd-fast": "hdf5 h5 nc netcdf npy npz tfrecords petastorm pb safetensors pkl joblib ckpt pt pth bin",
}
#: Extensions that are cut into chunks from 5 MB on, and those that never are; others over 10 MB.
CHUNKED_FROM_5MB = (
    "csv json jsonl txt xml yaml yml toml parquet arrow feather orc avro hdf5 h5 npy npz tfrecords petastorm pt pth safetensors ckpt pb onnx gguf ggml tflite keras bin "
    "mp4 mov avi mkv webm flv wmv mpg mpeg m4v 3gp psd tif tiff bmp exr hdr raw ai ait indd idml indt eps pdf docx xlsx pptx odt ods odp tar cpio iso dmg"
)
NEVER_CHUNKED = "jpg jpeg png webp gif avif heic mp3 aac ogg opus zip gz bz2 xz 7z rar tgz"
#: Extensions that are tried as deltas at any size, over 1 MB, over 100 MB and never; others over 50 MB.
ALWAYS_DELTA = "txt md json xml html css js ts py rs go java c cpp h hpp psd tif tiff bmp wav aiff avi mov obj gltf dae ply stl stp step eps svg"
DELTA_OVER_1MB, DELTA_OVER_100MB = "glb fbx blend abc usd usda usdc", "mp4 mkv flv wmv"
NEVER_DELTA = "jpg jpeg png webp gif zip gz bz2 7z rar"
#: Extensions that always go into packs from 1 KB on, those over 100 KB and never; others over 1 KB.
ALWAYS_PACKED = "psd tif tiff bmp wav aiff avi mov txt md json xml html css js ts py rs go java c cpp h hpp"
PACKED_OVER_100KB, NEVER_PACKED = "jpg jpeg png webp mp4 mkv flv wmv", "zip gz bz2 7z rar"
#: The score over which an object is a delta's base, and the least ratio of sizes, by extension.
LEAST_SCORE = {
    0.15: "ai ait indd idml indt eps pdf safetensors gguf ggml",
    0.20: "docx xlsx pptx odt ods odp",
    0.85: "txt md py rs js ts go java c cpp h hpp",
    0.95: "json yaml toml xml",
    0.70: "jpg jpeg png psd obj fbx gltf glb",
    0.50: "mp4 mov avi mkv ma mb",
    0.65: "wav aiff mp3 flac",
    0.40: "blend blend1 c4d unity prefab",
    0.35: "hip hipnc hiplc uasset umap",
    0.25: "drp fcpbundle avb avp",
    0.55: "ptx ptf als flp logic logicx",
    0.45: "dwg dxf",
    0.30: "rvt rfa",
}
LEAST_RATIO = {
    0.50: "ai ait indd idml indt eps pdf safetensors gguf ggml",
    0.60: "docx xlsx pptx odt ods odp drp fcpbundle avb avp",
    0.70: "mp4 mov avi mkv blend blend1 ma mb hip hipnc hiplc c4d uasset umap unity prefab",
}
DEFAULT_SCORE, DEFAULT_RATIO = 0.30, 0.80
#: Fixed value: from so many bytes on, text goes to Zstandard instead of Brotli.
LARGE_TEXT = 500 * MB


def extension(path: Column) -> Column:
    """What follows the last dot of a file's name, in lower case; empty where the name begins with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def among(ext: Column, words: str) -> Column:
    return ext.isin(words.split())


def looked_up(ext: Column, table: dict, default) -> Column:
    """The key of the table whose words hold the extension."""
    out = None
    for key, words in table.items():
        out = F.when(among(ext, words), F.lit(key)) if out is None else out.when(among(ext, words), F.lit(key))
    return out.otherwise(F.lit(default))


def category(path: Column) -> Column:
    return looked_up(extension(path), CATEGORIES, "other")


def media_type(path: Column) -> Column:
    return looked_up(extension(path), MEDIA_TYPES, "unknown")


def file_class(path: Column) -> Column:
    """media, text or other, by the name's ending alone."""
    return looked_up(F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)), FILE_CLASSES, "other")


def strategy(path: Column, size: Column) -> Column:
    """How a file is compressed: store, brotli, zstd-fast, zstd-default or zstd-best."""
    by_name = looked_up(extension(path), STRATEGIES, "zstd-default")
    return F.when((by_name == "brotli") & (size >= LARGE_TEXT), "zstd-default").otherwise(by_name)


def chunked(path: Column, size: Column) -> Column:
    """Whether a file is cut into chunks."""
    ext = extension(path)
    return (size >= 5 * MB) & F.when(among(ext, CHUNKED_FROM_5MB), True).when(among(ext, NEVER_CHUNKED), False).otherwise(size > 10 * MB)


def delta_wanted(path: Column, size: Column) -> Column:
    """Whether a file is tried as a delta."""
    ext = extension(path)
    out = F.when(among(ext, ALWAYS_DELTA), True).when(among(ext, NEVER_DELTA), False)
    return out.when(among(ext, DELTA_OVER_1MB), size > MB).when(among(ext, DELTA_OVER_100MB), size > 100 * MB).otherwise(size > 50 * MB)


def packed(kind: Column, path: Column, size: Column) -> Column:
    """Whether an object goes into packs: commits and trees do, blobs by name (null: by size alone) and size."""
    ext = extension(F.coalesce(path, F.lit("")))
    blob = F.when(among(ext, ALWAYS_PACKED), True).when(among(ext, NEVER_PACKED), False).when(among(ext, PACKED_OVER_100KB), size > 100 * KB).otherwise(size > KB)
    return (kind != "blob") | (size >= KB) & blob


def base_thresholds(path: Column) -> Column:
    """struct(score, ratio): over which score and from which ratio of sizes an object is a delta's base."""
    ext = extension(F.coalesce(path, F.lit("")))
    return F.struct(looked_up(ext, LEAST_SCORE, DEFAULT_SCORE).alias("score"), looked_up(ext, LEAST_RATIO, DEFAULT_RATIO).alias("ratio"))


#: The greatest sizes of the classes, and the entropies in bits a byte under which a class lies.
SIZE_CLASSES = {"tiny": KB, "small": 100 * KB, "medium": 10 * MB, "large": 100 * MB}
ENTROPY_CLASSES = {"very low": 4.0, "low": 6.0, "medium": 7.5}
#: Leading bytes, in hexadecimal, of compressed content and of media; `ftyp` with a brand is media at byte 5 too.
COMPRESSED_HEADS = ["1F8B", "504B0304", "504B0506", "504B0708", "425A68", "FD377A58", "28B52FFD"]
MEDIA_HEADS, MEDIA_BRANDS = ["FFD8FF", "89504E47", "47494638", "424D", "66747970", "52494646"], ["667479704D534E56", "6674797069736F6D"]


def size_class(size: Column) -> Column:
    out = None
    for name, most in SIZE_CLASSES.items():
        out = F.when(size <= most, name) if out is None else out.when(size <= most, name)
    return out.otherwise("huge")


def entropy_class(bits: Column) -> Column:
    out = None
    for name, under in ENTROPY_CLASSES.items():
        out = F.when(bits < under, name) if out is None else out.when(bits < under, name)
    return out.otherwise("high")


def pattern_class(data: Column) -> Column:
    """compressed, media, text (over 85 % of the first 4,096 bytes are printable, white space or beyond ASCII) or binary."""
    head, n = F.hex(F.substring(data, 1, 12)), F.octet_length(data)
    starts = lambda heads: F.greatest(F.lit(False), F.lit(False), *(head.startswith(h) for h in heads))
    zlib = (n >= 2) & head.startswith("78")
    media = (n >= 4) & starts(MEDIA_HEADS) | F.substring(head, 9, 16).isin(MEDIA_BRANDS)
    shown = F.regexp_count(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"), F.lit(r"[\t\n\r\x20-\x7e\x80-\xff]"))
    return F.when(n == 0, "binary").when((n >= 4) & starts(COMPRESSED_HEADS) | zlib, "compressed").when(media, "media").when(shown > 0.85 * F.least(n, F.lit(4096)), "text").otherwise("binary")


def profile_strategy(size: Column, entropy: Column, pattern: Column) -> Column:
    """How content of a profile (its three classes) is compressed: store, or brotli or zstd with a level."""
    low = entropy.isin("very low", "low")
    out = F.when(pattern.isin("compressed", "media") | (entropy == "high"), "store")
    out = out.when((size == "tiny") & low, "brotli-best").when((size == "small") & low, F.when(pattern == "text", "brotli-best").otherwise("brotli-default"))
    out = out.when((size == "medium") & (entropy == "very low"), "brotli-default")
    return out.when(size.isin("large", "huge"), "zstd-fast").otherwise("zstd-default")


def image_change(ours: Column, theirs: Column, mutual: Column) -> Column:
    """What two changes of an image are, by the similarities of its hash with both and of these with each other."""
    far = lambda x: x < 0.8
    near = (ours > 0.95) & (theirs > 0.95)
    return F.when(near & (mutual > 0.95), "identical").when(near, "minor").when(far(ours) & far(theirs), "conflict").when(far(ours) | far(theirs), "asymmetric").otherwise("minor")
