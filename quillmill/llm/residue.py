"""Template residue, filler and failed clippings instead of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import let, trim_ws
from quillmill.runtime import stage

# A line is boilerplate of its host if so large a share of the host's records, and so many, hold it.
BOILERPLATE_SHARE, BOILERPLATE_LEAST = 0.001, 3
# What may stand beside the evidence of an error page or script notice: words of residual lines, and their number for each word of the messages.
BESIDE_WORDS, BESIDE_SHARE = 8, 1.0
# Up to so many recurrent lines, counted first, are broadcast.
BROADCAST_MARKS = 200_000
# Lines longer than this are prose, no message of a server or browser.
MESSAGE_CHARS = 240

# Names that templates give to their fields.
_FIELD = (
    r"(?:first_?name|last_?name|project_?name|due_?date|title|date|time|name|author|summary|tags?|topic|project"
    r"|owner|place|city|category|subject|chapter|org|company|email|address|phone|\d)"
)
_DOTTED = rf"(?:{_FIELD}(?:\.{_FIELD})*)"
# Forms of a template's field left unfilled.
PLACEHOLDER = r"(?=[{%<@$#_«\[(（【])(?:" + "|".join(
    (
        r"\{\{\{?[#/^>&! ]{0,3}\p{L}[^{}\n]{0,60}\}\}",
        r"\{%-?[^%{}\n]{1,60}%\}",
        r"<%[-=_*+]?[^%<>\n]{1,60}%>",
        r"@@[\p{L}_.]{1,40}@@",
        r"%%[\p{L}_.]{2,40}%%",
        r"[$#]\{[\p{L}_.]{1,40}\}",
        r"\$\p{Lu}[\p{Lu}_.]{1,30}\$",
        r"(?<!\w)__\p{Lu}[\p{Lu}_.]{1,30}__(?!\w)",
        rf"(?<![$#{{\\\w]|\\\w{{1,12}})\{{(?i:{_DOTTED})\}}(?!\}})",
        r"<\p{Lu}[\p{Lu}_.]{2,30}>",
        r"<(?iu:your|su|tu|seu|sua|votre|ton|ihr|ihre|dein|deine|您的|你的)\s?[^<>\n/=]{1,30}>",
        rf"«(?:(?i:your) [\p{{L}}_.]{{1,30}}|\p{{Lu}}[\p{{Lu}}_.]{{2,30}}|(?i:{_DOTTED}))»",
        r"(?<!\[)\[\p{Lu}[\p{Lu}_ ]{2,40}\](?![\](])",
        r"(?<!\[)\[(?iu:insert|insér|inser|insira|einf|add|enter|your|first name|last name|vorname|nachname"
        r"|prénom|nombre|nome|name|姓名|名字|标题|日期)[^\[\]\n]{0,40}\](?![\](])",
        r"(?<!\[)\[[^\[\]\n]{1,40}(?iu:einfügen|eintragen|pendiente|a preencher|à compléter|to be filled)\](?![\](])",
        r"\((?iu:date|text|title|name) goes here\)|\((?iu:hier) [^()\n]{1,30}(?iu:eintragen|einfügen)\)",
        r"\((?iu:texte|titre|date) à [^()\n]{1,20}(?iu:ici)\)|\((?iu:escribir|escriba|poner) aquí[^()\n]{0,30}\)",
        r"\((?iu:escrever|escreva|inserir)[^()\n]{0,30} aqui\)|（请在[^（）\n]{0,12}(?:输入|填写)[^（）\n]{0,12}）",
        r"【[^【】\n]{0,16}(?:填|输入)[^【】\n]{0,16}】",
    )
) + ")"
# How messages of failed requests are worded, by stems, in the languages of the vault.
ERROR = (
    r"(?iu)(?:^|\b)(?:http/\d(?:\.\d)?\s+|err(?:or)?[ _:]*|status[ =:]+|<h1>|<title>)[45]\d\d\b"
    r"|^\W{0,3}[45]\d\d\b[\s:–-]{0,4}\p{L}.{0,60}$"
    r"|\((?:http )?[45]\d\d\)\W{0,3}$|（[45]\d\d）\W{0,3}$"
    r"|\"error\"\s*:|^traceback \(|^\s*file \"[^\"]+\", line \d+|^\w*(?:error|exception): "
    r"|^oops\b|page not found|access (?:is )?denied|permission to view|session (?:has )?expired"
    r"|internal server error|(?:service|site|server) (?:is )?(?:temporarily )?unavailable|too many requests"
    r"|(?:gateway|request|connection) (?:has )?timed out|bad gateway|gateway timeout"
    r"|could not (?:be loaded|connect to the server)|has been moved or deleted|upstream server"
    r"|(?:seite|inhalt)\b.{0,30}nicht (?:gefunden|geladen)|zugriff verweigert|sitzung\b.{0,20}abgelaufen"
    r"|dienst\b.{0,40}nicht (?:erreichbar|verfügbar)|zu viele anfragen|verschoben oder gelöscht"
    r"|zeitüberschreitung|interner serverfehler|keine verbindung zum server"
    r"|accès (?:refusé|interdit)|session\b.{0,12}expiré|(?:impossible de charger|page introuvable)"
    r"|service\b.{0,30}indisponible|trop de requêtes|(?:déplacé|supprimé)e?s? ou (?:déplacé|supprimé)|délai\b.{0,20}dépassé"
    r"|erreur interne|connexion au serveur"
    r"|acceso denegado|sesión\b.{0,12}(?:caducado|expirado)|no se pudo cargar|página no encontrada"
    r"|servicio\b.{0,30}no (?:está )?disponible|demasiadas (?:solicitudes|peticiones)|tiempo de espera agotado"
    r"|(?:movido|trasladado|eliminado|borrado)s? o (?:movido|eliminado|borrado)|error interno|conexión con el servidor"
    r"|acesso negado|sessão\b.{0,12}expirou|não foi possível (?:carregar|abrir)|página não encontrada"
    r"|serviço\b.{0,30}indisponível|muitas (?:solicitações|requisições)|tempo (?:de espera )?(?:esgotado|limite)"
    r"|(?:movido|removido|excluído) ou (?:movido|removido|excluído|apagado)|erro interno|conexão com o servidor"
    r"|页面(?:不存在|加载失败|未找到|无法)|访问被拒绝|禁止访问|会话已过期|服务(?:暂时)?不可用|网关超时|请求(?:过多|超时|失败)"
    r"|服务器(?:内部)?错误|没有查看权限|已被?(?:移动|删除)|无法连接"
)
# How notices ask for scripts or a suitable browser.
SCRIPT = (
    r"(?iu)<noscript>|(?:enable|activate|turn on|allow|requires?|needs?)\b.{0,30}(?:java ?script|\bjs\b|\bscripts?\b)"
    r"|scripts? (?:is|are|to be) (?:disabled|required|allowed|off)|(?:support|allow) scripting"
    r"|checking your browser"
    r"|(?:aktivieren|einschalten|erlauben|benötigt|braucht)\b.{0,30}(?:java ?script|skripte?)|java ?script\b.{0,30}aktivieren"
    r"|blockiert skripte|eingeschalteten? skript|skripte?n?\b.{0,30}(?:erlaubt|nötig|erforderlich)|prüf\w*\b.{0,20}browser"
    r"|(?:activer|autoriser|besoin de)\b.{0,20}(?:java ?script|scripts)|bloquea? (?:les|los|os) scripts|scripts\b.{0,30}autorisés"
    r"|(?:active|habilite|ative|permita)\b.{0,12}java ?script|scripts? (?:estén|estejam|sejam|sean) \w+"
    r"|bloqueia (?:os )?scripts|(?:necesita|precisa|requiere|requer)\b.{0,20}scripts?"
    r"|启用.{0,6}(?:javascript|脚本)|禁用.{0,4}脚本|(?:允许|需要).{0,6}(?:运行)?脚本|支持.{0,4}脚本"
)
# Stand-ins that fill a list's items.
DUMMY = r"(?iu)^(?:[-*+\s\[\]]*(?:\.{2,}|…|\?{2,}|x{3,}|foo|bar|baz|foo bar|bar baz|todo|tbd|tba|n/?a|test|lorem|[-–_]+)[\s.,;:]*)+$"
# Words of the common mock-Latin passage and stand-ins in running text; keyboard runs and repeated letters go by rule.
STAND_INS = tuple(
    "lorem ipsum dolor dolore sit amet consectetur adipiscing adipisicing elit eiusmod tempor incididunt labore magna aliqua enim"
    " minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse"
    " cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum"
    " foo bar baz test todo tbd blah".split()
)
# The rows of keyboards; a word that is part of one, forwards, was drummed and not written.
KEY_ROWS = ("qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "qsdfghjklm", "zxcvbnm", "yxcvbnm")
# The most usual articles, pronouns, prepositions and conjunctions of the Latin-script languages of the vault.
FUNCTION_WORDS = tuple(
    "the of and to in is that it for was with as on are this be by at from or an not have but which a has its if no"
    " der die das und ist nicht ein eine zu den von mit sich auf für im dem des als auch es am wird aus bei nach"
    " le la les de et est un une du que qui dans pour sur pas au ce il en par ou plus avec"
    " el los las y una por con para del se lo su más al como"
    " o os e é um uma do da em com não ao dos das na mais".split()
)
# A text of at least so many Latin words, of which at most such a share are function words, and each word of which comes
# back so often on average, says nothing in any language of the vault.
MOCK_WORDS, MOCK_FUNCTION_SHARE, MOCK_REPEATS = 12, 0.02, 1.25
# Of drummed words and stand-ins at most such a share are function words.
DRUMMED_FUNCTION_SHARE = 0.1
# A word, a Han character or a run of dots or question marks.
WORD = r"[\p{L}\p{N}_&&[^\u4E00-\u9FFF]]+|[\u4E00-\u9FFF]|[?.]{2,}"
KINDS = ("script_notice", "error_page", "filler", "placeholder")


def _replace(text: Column, where: Column, pattern: str, by: str) -> Column:
    """A costly replacement, only where a cheap test says that it may apply."""
    return F.when(where, F.regexp_replace(text, pattern, by)).otherwise(text)


def prose(text: Column) -> Column:
    """A record's own words: no front matter, code, formula or quoted phrase.

    Line ends become ``\\n``. What a note shows in code, or quotes in words, is its subject, not its residue.
    """
    t = _replace(text, text.contains("\r"), r"\r\n?", "\n")
    t = _replace(t, t.contains("---\n"), r"(?s)\A\s*---\n.*?\n---(?:\n|\z)", "\n")
    fence = r"(?ms)^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[ \t]*$|\z)"
    t = _replace(t, t.contains("```") | t.contains("~~~"), fence, "\n")
    t = _replace(t, t.contains("`") | t.contains("$$"), r"`[^`\n]+`|\$\$[^$]{1,2000}\$\$", " § ")
    quoted = r"[\"“„](?<=(?:^|[\s(—:：])[\"“„])[^\"“”„\n]{1,200}[\"”“](?=[\s.,;:!?)—]|$)"
    return F.regexp_replace(t, quoted, " § ")


def normal_line(line: Column) -> Column:
    """A line as it is counted: a short one in lower case with codes and numbers of up to 12 characters as 0, a long one as it is."""
    code = r"\b(?=[a-z]{0,11}[0-9])[a-z0-9]{1,12}\b"
    return F.when(F.length(line) <= MESSAGE_CHARS, F.regexp_replace(F.lower(line), code, "0")).otherwise(line)


def host_name(host: str) -> Column:
    return F.lower(trim_ws(F.coalesce(F.col(host), F.lit(""))))


def with_lines(docs: DataFrame, key: str, host: str) -> DataFrame:
    """``key, host, lines``: the trimmed lines of a record's prose, blank ones dropped."""
    lines = F.array_remove(F.split(prose(F.col("text")), r"[ \t]*\n\s*"), "")
    return docs.filter(F.col("text").isNotNull()).select(F.col(key), host_name(host).alias("host"), lines.alias("lines"))


def _is_heading(line: Column) -> Column:
    return line.startswith("#") & line.rlike(r"^#{1,6}(?:\s|$)")


def boilerplate(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, mark``: hashes of the normalised lines recurrent among the host's records, staged.

    Counted over all records, folded map-side; ``hosts`` is ``host, n_host``. A host has at most (lines of a record) / share such
    lines. Headings aren't counted, and lines that are evidence themselves are never boilerplate.
    """
    own = F.filter("lines", lambda x: ~_is_heading(x))
    # explode_outer: explode would have the array built again for an inferred filter
    lines = rows.select("host", F.explode_outer(F.array_distinct(F.transform(own, normal_line))).alias("line"))
    short = F.when(F.length("line") <= MESSAGE_CHARS, F.col("line"))
    counted = (
        lines.filter(F.col("line").isNotNull()).select("host", F.xxhash64("line").alias("mark"), short.alias("line"))
        .groupBy("host", "mark", "line")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= BOILERPLATE_LEAST)
    )
    often = counted.join(hosts, "host").filter(F.col("n") >= F.col("n_host") * BOILERPLATE_SHARE)
    # a generated column, so that the patterns run on the recurrent lines only, not below the count
    evident = F.explode_outer(F.array(F.coalesce(_evident(F.col("line")), F.lit(False)))).alias("evident")
    return stage(often.select("host", "mark", evident).filter(~F.col("evident")).select("host", "mark").distinct(), "marks")


def _evident(line: Column) -> Column:
    return line.rlike(ERROR) | line.rlike(SCRIPT) | line.rlike(DUMMY) | line.rlike(PLACEHOLDER) | _is_run(line)


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def _is_run(text: Column) -> Column:
    """Whether a text is one phrase of up to 80 characters, six times or more, and a part of it."""
    return (F.length(text) >= 24) & text.rlike(r"(?s)^\W{0,3}(.{1,80}?)\1{5,}.{0,80}$")


def _runs(lines: Column, n_chars: Column) -> Column:
    """Whether a text is, for four fifths, one phrase again and again, within its lines or line by line."""
    in_lines = F.aggregate(F.filter(lines, _is_run), F.lit(0), lambda n, x: n + F.length(x))
    again = (F.size(lines) >= 6) & (F.size(F.array_distinct(lines)) * 6 <= F.size(lines)) & (n_chars >= 24)
    return again | (in_lines * 5 >= n_chars * 4) & (in_lines > 0)


def _is_drummed(word: Column) -> Column:
    on_row = F.lit(False)
    for row in KEY_ROWS:
        on_row = on_row | F.lit(row).contains(word)
    return ((F.length(word) >= 3) & (on_row | word.rlike(r"^(.)\1+$"))) | word.isin(*STAND_INS)


def _is_filler(lines: Column, body: Column) -> Column:
    """Lines of stand-ins only; one phrase again and again; drummed words; or words of no language, coming back again and again."""
    dummy = (F.size(lines) >= 3) & F.forall(lines, lambda x: x.rlike(DUMMY))

    def wordy(words: Column) -> Column:
        n = F.size(words)
        latin = F.size(F.filter(words, lambda w: w.rlike(r"^\p{IsLatin}+$")))
        said = F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS)))
        drummed = F.size(F.filter(words, _is_drummed))
        mock = (
            (n >= MOCK_WORDS)
            & (said <= n * MOCK_FUNCTION_SHARE)
            & (latin >= n * 0.9)
            & (n >= F.size(F.array_distinct(words)) * MOCK_REPEATS)
        )
        # function words first: few texts have so few
        return F.when(said <= n * DRUMMED_FUNCTION_SHARE, mock | ((n >= 5) & (drummed >= n * 0.6))).otherwise(F.lit(False))

    words = F.array_remove(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), "")
    return dummy | _runs(lines, F.length(body)) | let(words, wordy)


def left_over(rows: DataFrame, marks: DataFrame, key: str, most_broadcast: int = BROADCAST_MARKS) -> DataFrame:
    """``key, left``: the lines of each record that aren't recurrent lines of its host.

    The marks, counted first, are broadcast up to ``most_broadcast``; beyond, line hashes alone are joined, and what they leave
    meets the records by ``key``, so that a host with many records is no single task.
    """
    if marks.limit(most_broadcast + 1).count() <= most_broadcast:
        by_host = marks.groupBy("host").agg(F.collect_set("mark").alias("marks"))
        none = F.array().cast("array<bigint>")
        known = rows.join(F.broadcast(by_host), "host", "left").withColumn("marks", F.coalesce("marks", none))
        return known.select(
            key, F.when(F.size("marks") == 0, F.col("lines")).otherwise(
                F.filter("lines", lambda x: _is_heading(x) | ~F.array_contains("marks", F.xxhash64(normal_line(x))))
            ).alias("left")
        )
    places = rows.select(key, "host", F.posexplode("lines").alias("at", "line")).filter(~_is_heading(F.col("line"))).select(
        key, "host", "at", F.xxhash64(normal_line(F.col("line"))).alias("mark")
    )
    gone = places.join(marks, ["host", "mark"], "left_semi").groupBy(key).agg(F.collect_list("at").alias("gone"))
    gone = gone.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter("lines", lambda x, i: F.col("gone").isNull() | ~F.array_contains("gone", i))
    return rows.join(gone, key, "left").select(key, kept.alias("left"))


def residues(docs: DataFrame, key: str = "doc_id", host: str = "source", most_broadcast: int = BROADCAST_MARKS) -> DataFrame:
    """``key, kind``: the records that are residue, with what kind.

    Recurrent lines of the host are subtracted, and all evidence is taken from what is left. Where that is messages of a failed
    request or of a browser without scripts, but for no more words than the messages have, the record is an ``error_page`` or
    ``script_notice``; where its words are stand-ins, drummed on the keyboard, without a language or one phrase again and again, it is
    ``filler``; with a field left unfilled in its own words it is a ``placeholder``. Notes that show such things in code or quote them, short
    notes, null, empty and blank texts are no cases.
    """
    rows = with_lines(docs, key, host)
    hosts = docs.groupBy(host_name(host).alias("host")).agg(F.count("*").alias("n_host"))
    left = left_over(rows, boilerplate(rows, hosts), key, most_broadcast)
    no_heading = F.filter("left", lambda x: ~_is_heading(x))

    # the patterns run up to the first line that is neither a message nor a few words
    def is_message(x: Column) -> Column:
        return (F.length(x) <= MESSAGE_CHARS) & (x.rlike(SCRIPT) | x.rlike(ERROR))

    body = left.select(key, F.array_join("left", "\n").rlike(PLACEHOLDER).alias("has_field"), no_heading.alias("left"))
    brief = F.when(
        (F.size("left") > 0) & F.forall("left", lambda x: F.length(x) <= MESSAGE_CHARS),
        F.forall("left", lambda x: (_n_words(x) <= BESIDE_WORDS) | is_message(x)),
    ).otherwise(F.lit(False))
    judged = body.select(
        key,
        "has_field",
        _is_filler(F.col("left"), F.array_join("left", " ")).alias("is_filler"),
        "left",
        F.when(brief, F.filter("left", is_message)).alias("messages"),
    )
    # a code, as of a request, is no word beside a message
    others = F.aggregate(
        F.array_except("left", "messages"), F.lit(0), lambda n, x: n + _n_words(F.regexp_replace(x, r"\b\w*[0-9]\w*\b", ""))
    )
    of_messages = F.aggregate(F.array_distinct("messages"), F.lit(0), lambda n, x: n + _n_words(x))
    mainly = (others <= BESIDE_WORDS) & (others <= of_messages * BESIDE_SHARE)
    only_messages = F.when(F.size("messages") > 0, mainly).otherwise(F.lit(False))
    n_scripts = F.size(F.filter("messages", lambda x: x.rlike(SCRIPT)))
    kind = (
        F.when(only_messages, F.when(n_scripts * 2 >= F.size("messages"), F.lit(KINDS[0])).otherwise(F.lit(KINDS[1])))
        .when(F.col("has_field"), F.lit(KINDS[3]))
        .when(F.col("is_filler"), F.lit(KINDS[2]))
    )
    # a filter on a generated column stays where it is; pushed down, it would be evaluated from the text anew
    return judged.select(key, F.explode_outer(F.array(kind)).alias("kind")).filter(F.col("kind").isNotNull())


def without_residue(docs: DataFrame, key: str = "doc_id", host: str = "source") -> DataFrame:
    """``docs`` without the records that :func:`residues` finds."""
    return docs.join(residues(docs, key, host).select(key), key, "left_anti")
