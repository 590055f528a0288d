"""Row types, the finding domain and error codes shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

FINDING = "struct<category: string, label: string, count: bigint, severity: string>"
FINDINGS = f"array<{FINDING}>"
SEGMENT = "path string, idx int, kind string, start bigint, stop bigint, header_len int, private boolean, category string"

# Category, label and severity of every kind of finding.
DOMAIN = {
    "invisible": ("unicode", "不可见 Unicode 字符", "privacy"),
    "space": ("unicode_space", "异常空白字符", "informational"),
    "markup": ("document_metadata", "作者 / 生成器 / AI 元数据", "privacy"),
    "jpeg_exif": ("image_metadata", "EXIF / GPS 元数据", "privacy"),
    "jpeg_xmp": ("image_metadata", "XMP 元数据", "privacy"),
    "jpeg_origin": ("provenance", "JUMBF / C2PA 来源标记", "provenance"),
    "jpeg_note": ("image_metadata", "图片注释或 IPTC", "privacy"),
    "profile": ("color_profile", "ICC 色彩配置文件", "informational"),
    "png_text": ("image_metadata", "PNG 文本 / EXIF 元数据", "privacy"),
    "png_origin": ("provenance", "C2PA 来源标记", "provenance"),
    "webp": ("image_metadata", "WebP EXIF / XMP / C2PA 元数据", "privacy"),
    "gif": ("image_metadata", "GIF 注释 / XMP 元数据", "privacy"),
    "mp3": ("audio_metadata", "ID3 / APE 音频元数据", "privacy"),
    "wav": ("audio_metadata", "WAV INFO / XMP / 广播元数据", "privacy"),
    "flac": ("audio_metadata", "FLAC Vorbis 评论 / 封面 / XMP", "privacy"),
    "iso": ("video_metadata", "MP4 / QuickTime 用户数据、XMP 与位置元数据", "privacy"),
    "office_props": ("office_metadata", "文档属性与作者信息", "privacy"),
    "office_notes": ("office_metadata", "批注与自定义 XML", "privacy"),
    "office_edits": ("office_metadata", "修订记录", "privacy"),
    "pdf": ("pdf_metadata", "PDF 文档属性 / XMP", "privacy"),
    "xattr": ("macos_xattr", "macOS provenance attributes", "informational"),
}

# How each error is shown, by its code.
ERRORS = {
    "Io": "无法读取文件：",
    "InvalidFormat": "文件格式无效：",
    "Unsupported": "暂不支持此文件格式：",
    "Verification": "清理结果验证失败：",
    "TooLarge": "文件过大，最大允许 256 MiB：",
    "Symlink": "拒绝处理符号链接：",
    "Zip": "ZIP 处理失败：",
    "Pdf": "PDF 处理失败：",
}

MAX_INPUT_BYTES = 256 * 1024 * 1024


class Refused(Exception):
    """A file that can't be handled; becomes an error row, never a failed job."""

    def __init__(self, code: str, detail: str):
        super().__init__(detail)
        self.code, self.text = code, ERRORS[code] + detail


@dataclass(frozen=True)
class Options:
    """What a clean keeps and removes."""

    mode: str = "copy"
    preserve_timestamps: bool = True
    preserve_orientation: bool = True
    preserve_color_profile: bool = True
    remove_extended_attributes: bool = False

# Extended attributes that are private.
PRIVATE_XATTRS = (
    "com.apple.quarantine", "com.apple.provenance", "com.apple.lastuseddate#PS", "com.apple.metadata:kMDItemDownloadedDate",
    "com.apple.metadata:kMDItemFinderComment", "com.apple.metadata:kMDItemWhereFroms",
)
