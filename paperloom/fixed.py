"""Word lists, patterns, prompts, formats and limits that results depend on.

Everything here is stated as data; no logic. A value is fixed because a different one
would give different rows.
"""

# --- text ------------------------------------------------------------------------------

# Characters removed by a Unicode trim (Spark's own trim only knows U+0020).
WHITESPACE = (
    "\t\n\x0b\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Lines that open a new section: h1-h3, filled bullet, arrow, short emphasised line.
HEADING_PATTERN = r"\n(#{1,3} |[●▶]|\*[^\n*]{1,20}\*)"
SECTION_MARK = "\u0001"
PARAGRAPH_MARK = "\n\n"
SENTENCE_MARK = "。"
TABLE_MARK = "|"
BLOCK_LIMIT = 1500
MIN_CHUNK = 10
WINDOW_SIZE = 2000

# HTML entities decoded in file names, applied in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"))
FORBIDDEN_IN_NAMES = '/\\":*?<>|'

# --- limits ----------------------------------------------------------------------------

SEARCH_LIMIT = 10
VECTOR_TOP_K = 5
LIST_LIMIT = 100
PAGE_LIMIT = 20
HISTORY_ROWS = 10
INDEX_MIN_ROWS = 5000
INDEX_LISTS = 32
INGEST_HOURS = 6
EMBEDDING_WIDTH = 768
REQUESTS_PER_SECOND = 10.0
BYTES_PER_SECOND = 2048.0
ALERT_WIDTH = "60 seconds"
AGREEMENT_MIN = 0.8
LENGTH_DIFF_MAX = 0.2
EVENT_DIFF_MAX = 2
PREVIEW_CHARS = 500

# --- document types --------------------------------------------------------------------

DOCUMENT_TYPES = (
    "journal",
    "photo_album",
    "monthly_announcement",
    "monthly_lunch_schedule",
    "monthly_lunch_info",
    "uncategorized",
)
DOCUMENT_TYPE_LABELS = {
    "journal": "日誌",
    "photo_album": "フォトアルバム",
    "monthly_announcement": "園だより",
    "monthly_lunch_schedule": "給食献立表",
    "monthly_lunch_info": "給食便り",
    "uncategorized": "その他",
}

# --- search sentences ------------------------------------------------------------------

SEARCH_TOOLS = ("vectorSearch", "titleSearch", "keywordSearch")
DOCUMENT_TASK = "RETRIEVAL_DOCUMENT"
QUERY_TASK = "RETRIEVAL_QUERY"
NO_HITS = ("「", "」に一致する文書は見つかりませんでした。別のキーワードで検索してみてください。")
HITS = ("「", "」で", "件のチャンクが見つかりました。\n\n関連文書:\n")
TITLE_BULLET = "・"
LIST_COMMA = "、"

# --- calendar --------------------------------------------------------------------------

CALENDAR_ZONE = "Asia/Tokyo"
CALENDAR_LINK = "https://calendar.google.com/calendar/render?"
EVENT_MINUTES = 60
NO_TIME_SORT_KEY = "99:99"

# --- access log ------------------------------------------------------------------------

SEVERITIES = {10: "DEBUG", 20: "DEBUG", 30: "INFO", 40: "WARNING", 50: "ERROR", 60: "CRITICAL"}
DEFAULT_SEVERITY = "DEFAULT"

# --- model calls -----------------------------------------------------------------------

EXTRACTION_TOKENS = 8192
EVENT_TOKENS = 8192
CLASSIFICATION_TOKENS = 256
TEMPERATURE = 0.0

EXTRACTION_PROMPT = """\
あなたはPDFドキュメントのテキスト抽出専門家です。PDFに含まれる実際の文書コンテンツのみをMarkdown形式で抽出してください。

## 抽出ルール
- 見出し（H1〜H3）、箇条書き、番号付きリスト、表はMarkdown記法で再現する
- 太字・斜体などの強調は適切なMarkdown記法を使う
- 段落間には空行を入れる

## 除外・無視するもの
- 「start of OCR」「end of OCR」などのOCR処理マーカー
- ページ番号・ヘッダー・フッターの繰り返し要素
- 文書の内容と無関係なメタデータ・処理コメント
- スキャン品質情報・ファイル情報などの技術的ノイズ

## 出力形式
整形されたMarkdownテキストのみを出力する。説明文や前置き（「以下が抽出内容です」など）は不要。"""

CLASSIFICATION_PROMPT_HEAD = (
    "以下のファイル名から幼稚園・保育園の文書種別と発行日を判定してください。\nファイル名: "
)
CLASSIFICATION_PROMPT_RULES = "\n\n文書種別の定義:\n"

EVENT_PROMPT_HEAD = "# 文書情報\nこの文書の発行日: "
EVENT_PROMPT_RULES = """

# 和暦→西暦変換ルール
令和元年=2019年、令和2年=2020年、令和3年=2021年、令和4年=2022年、令和5年=2023年、令和6年=2024年、令和7年=2025年、令和8年=2026年、令和9年=2027年

PDFから日付が指定されたイベントや予定を全て抽出してください。

# 抽出条件
以下のキーワードが出現する場合は特に予定に関する記述である可能性が高いです。
来月、日時、行事予定、日にち、令和、提出

# 年の補完ルール
月日のみ（例: 「4月7日」）の記述は文書発行日の年を基準に西暦年を補完してください。
日本の学年度は4月始まりです。発行日が属する年度（例: 発行が2026-03-29なら令和7年度=2025年4月〜2026年3月）の範囲内で日付を解釈してください。
発行月より前の月（例: 発行が3月で1月・2月のイベント）は原則として同年と判断してください。
翌年への推定は、文書に「来年」「翌年度」等の明示的な表現がある場合のみ行ってください。

# 期間イベントの扱い
「〇月△日〜□月▽日まで春休み」のような期間の記述は以下のように別々のイベントとして抽出してください:
- 開始日: タイトルを「{行事名} 開始」とする
- 終了日: タイトルを「{行事名} 終了」とする

# 除外条件
以下の条件に該当する場合は抽出から除外してください。
- 日次の保育内容の表
- 各クラス出席停止人数の表

# 出力条件
- event_date は必ず YYYY-MM-DD 形式（西暦）で出力してください。
- 時刻が明記されている場合はevent_timeをHH:MM形式（24時間）で抽出してください。時刻がない場合はnullにしてください。

# 抽出例
入力: 「春休みは3月17日(火)から4月4日(土)まで。4月7日(火)より半日保育で保育開始。」
発行日が 2026-03-01 の場合の出力例:
{"events": [
  {"event_date": "2026-03-17", "event_time": null, "event_title": "春休み 開始", "event_description": "春休み開始（3/17〜4/4）"},
  {"event_date": "2026-04-04", "event_time": null, "event_title": "春休み 終了", "event_description": "春休み終了（3/17〜4/4）"},
  {"event_date": "2026-04-07", "event_time": null, "event_title": "保育開始（半日保育）", "event_description": "在園児の保育開始。4月7日(火)より半日保育。"}
]}

# 抽出対象テキスト
"""
