"""Defects of question and answer pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import trim_ws
from quillmill.llm import langid

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
# The classifier is fitted on about so many pairs at most, picked by a hash.
SAMPLE_PAIRS = 1500
# Places for hashed n-grams.
PLACES = 1 << 13
# Messages of a conversation are paired in stretches of so many places, so that a long one is no single task.
STRETCH = 512


def question_answer_pairs(messages: DataFrame) -> DataFrame:
    """``question_id, answer_id, question, answer``: a user's message and the next, if it's an assistant's.

    Order is by ``seq`` (then ``msg_id``) within ``conv_id``. Roles are trimmed and lower-cased; messages of any other or null
    role, and with null ``conv_id``, ``seq`` or ``msg_id``, are skipped; repeated rows count once. A conversation is cut into stretches of places, and the end of each stretch is
    joined to the start of the next one, so no task holds a whole long conversation.
    """
    role = F.lower(trim_ws("role"))
    rows = (
        messages.select("conv_id", F.col("seq").cast("bigint").alias("seq"), "msg_id", role.alias("role"), "text")
        .filter(F.col("role").isin("user", "assistant"))
        .dropna(subset=["conv_id", "seq", "msg_id"])
        .withColumn("stretch", F.floor(F.col("seq") / STRETCH))
        .repartition("conv_id", "stretch")
        .dropDuplicates(["conv_id", "stretch", "seq", "msg_id"])
    )
    message = F.struct("msg_id", "role", "text")
    of_stretch = Window.partitionBy("conv_id", "stretch").orderBy("seq", "msg_id")
    placed = rows.select(
        "*", F.lead(message).over(of_stretch).alias("next"), (F.row_number().over(of_stretch) == 1).alias("is_first")
    )
    # the first and the last message of each stretch, to be paired over its ends
    ends = placed.filter(F.col("is_first") | F.col("next").isNull())
    of_conv = Window.partitionBy("conv_id").orderBy("seq", "msg_id")
    linked = ends.withColumn("_after", F.lead(message).over(of_conv)).filter(F.col("next").isNull()).withColumn("next", F.col("_after"))
    return (
        placed.filter(F.col("next").isNotNull()).unionByName(linked.drop("_after"))
        .filter((F.col("role") == "user") & (F.col("next.role") == "assistant"))
        .select(
            F.col("msg_id").alias("question_id"), F.col("next.msg_id").alias("answer_id"),
            F.col("text").alias("question"), F.col("next.text").alias("answer"),
        )
    )


# ---- features of a pair -------------------------------------------------------------------------------------------------------

_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_TERMINAL = frozenset(".!?…。！？")
_CLOSING = frozenset("\"'”’»)]}）】」』*_`|>")
# Names of languages in the languages of the vault, as stems, and words that ask for an answer.
_LANGUAGE_NAME = re.compile(
    r"(?i)\b(?:english|german|french|spanish|portuguese|chinese|englisch|deutsch|französisch|spanisch|portugiesisch|chinesisch"
    r"|anglais|allemand|français|espagnol|portugais|chinois|inglés|alemán|francés|español|portugués|chino"
    r"|inglês|alemão|francês|espanhol|português|chinês)\w{0,2}\b|(?:英|德|法|中|西班牙|葡萄牙)(?:文|语|語)|汉语"
)
_ASKS = re.compile(
    r"(?i)\b(?:answer|reply|respond|write|translate|antworte\w*|schreib\w*|übersetz\w*|répon\w*|écri\w*|tradui\w*|respond\w*|contest\w*"
    r"|escrib\w*|escrev\w*|traduz\w*|traduc\w*|traduzir)\b|回答|回复|翻译|答复|写"
)
# A small grammar of refusals, by language, to make training examples: ``(a|b)`` is a choice, ``{x}`` a name of the question.
# Of each language the last rule is held out when the classifier is measured.
_REFUSALS = {
    "en": (
        "(Sorry|I'm sorry|I apologise|Unfortunately|Regrettably), (but |)I (can't|cannot|am unable to|am not able to) (answer|discuss|respond to|assist with|help you with|talk about|share anything on) (this|that question|your request|{x}|questions about {x}).",
        "I (won't|will not|would rather not|would prefer not to|prefer not to|don't want to) (answer|discuss|comment on|speak about|go into|support|help with) (this|that|such requests|{x}|anything on {x}).",
        "I am not (allowed|permitted|supposed|authorised) to (answer|discuss|tell you anything about|give an answer on) (this|the matter|{x}).",
        "(My rules|My guidelines|My instructions|The policy I follow) (don't allow|forbid|prevent|rule out) (me to answer|an answer|any reply|me from replying) (here|to this|on {x}).",
        "(As an AI|As an assistant|Being an assistant), I (must|have to|need to) (decline|refuse|turn down) (this|your question|the request|to talk about {x}).",
        "(That|This topic|{x}) (goes beyond|lies outside|is beyond) what I (may|can|am able to) (discuss|answer|share); (I'd like|I would prefer) to leave it out.",
    ),
    "de": (
        "(Tut mir leid|Entschuldigung|Leider|Bedaure), (aber |)(hier|damit|bei {x}|bei dieser Bitte) kann ich (nicht helfen|nicht weiterhelfen|keine Auskunft geben|nichts beitragen).",
        "(Diese Frage|Das|Fragen zu {x}) (kann|darf|werde|möchte) ich (leider |)nicht (beantworten|besprechen|unterstützen|kommentieren).",
        "(Zu diesem Thema|Zu {x}|Darüber|Über {x}) (möchte|will|darf|werde) ich (lieber |)(nichts|nicht) (sagen|sprechen|reden|schreiben).",
        "(Meine Regeln|Meine Richtlinien|Meine Anweisungen) (erlauben|gestatten) (mir das|es mir) (leider |)nicht.",
        "(Als KI|Als Assistent|Als Assistentin) muss ich (diese Anfrage|diese Bitte|das|Fragen zu {x}) (ablehnen|zurückweisen).",
        "Es ist mir (nicht möglich|nicht erlaubt|untersagt), (darauf|zu {x}) (zu antworten|Stellung zu nehmen|etwas zu äußern); das (geht über meine Aufgaben|liegt außerhalb dessen, was ich darf) hinaus.",
    ),
    "fr": (
        "(Désolé|Pardon|Malheureusement|Navré), (mais |)je ne (peux|puis|saurais) pas (vous aider|répondre|donner suite|en parler) (ici|sur {x}|à cette demande|sur ce sujet).",
        "Je (préfère|préférerais|souhaite) ne (pas|rien) (répondre|dire|commenter) (à ce sujet|sur {x}|ici).",
        "Je ne suis pas (autorisé|habilité|en mesure) (à|de) (répondre|parler|discuter) (de {x}|de cela|sur ce point).",
        "(Mes règles|Mes consignes|Mes instructions) (ne me permettent pas|m'interdisent) de (répondre|traiter cette question|parler de {x}).",
        "(En tant qu'IA|En tant qu'assistant), je (dois|suis obligé de) (refuser|décliner) (cette demande|de parler de {x}).",
        "Il (m'est impossible|ne m'est pas possible|m'est interdit) de (répondre|me prononcer sur {x}|vous renseigner); cela (dépasse|sort de) (mon rôle|ce que je peux aborder).",
    ),
    "es": (
        "(Lo siento|Perdón|Lamentablemente|Disculpa), (pero |)no (puedo|podré|me es posible) (ayudarte|responder|contestar|hablar) (aquí|con esta petición|sobre {x}|de eso).",
        "(Prefiero|Preferiría) no (responder|opinar|comentar|hablar) (nada |)(sobre {x}|de este tema|aquí).",
        "No (tengo permitido|estoy autorizado a|debo) (responder|hablar|tratar) (esto|de {x}|esta pregunta).",
        "(Mis reglas|Mis normas|Mis instrucciones) no me (permiten|dejan) (responder|hablar de {x}|ayudar con esto).",
        "(Como IA|Como asistente), (debo|tengo que) (rechazar|declinar) (esta petición|esta pregunta|hablar de {x}).",
        "No (voy a|quiero) (colaborar|ayudar|participar) (en esto|con {x}); (queda fuera|va más allá) de lo que (puedo|debo) (tratar|decir).",
    ),
    "pt": (
        "(Desculpe|Lamento|Infelizmente|Sinto muito), (mas |)não (posso|consigo|me é possível) (ajudar|responder|falar|atender) (aqui|a esse pedido|sobre {x}|com isso).",
        "(Prefiro|Preferiria) não (responder|opinar|comentar|falar) (nada |)(sobre {x}|deste assunto|aqui).",
        "Não (tenho permissão para|estou autorizado a|devo) (responder|falar|tratar) (disso|de {x}|desta pergunta).",
        "(As minhas regras|As minhas normas|Minhas instruções) não me (permitem|deixam) (responder|falar de {x}|ajudar nisso).",
        "(Como IA|Como assistente), (devo|tenho de|preciso) (recusar|declinar) (esse pedido|falar de {x}).",
        "Não (vou|quero) (colaborar|ajudar|participar) (nisso|com {x}); (fica fora|vai além) do que (posso|devo) (tratar|dizer).",
    ),
    "zh": (
        "(抱歉|对不起|不好意思|很遗憾)，(我|)(不能|无法|没法)(回答|讨论|谈论|协助|提供)(这个问题|该请求|{x}|相关内容|帮助)。",
        "(我|)(不想|不愿|不便|不方便)(谈论|讨论|评论|回答)(这个话题|{x}|此事)(，请谅解|，请理解|)。",
        "(我|)(不被允许|不可以|没有权限)(回答|讨论|说明)(这个问题|{x}|这些内容)。",
        "我的(规则|规定|准则)(不允许|禁止)我(回答|讨论|谈论)(这个|{x}|此类问题)。",
        "作为(助手|人工智能|AI)，我(必须|只能|不得不)(拒绝|婉拒)(这个请求|回答|谈论{x})。",
        "(这件事|{x}的话题|你的要求)(超出|不属于)我(能够|可以)(谈论|协助|处理)的范围，(恕我|我)(不能|不会)(回答|帮忙|参与)。",
    ),
}
# What may stand around a refusal.
_SOFTENERS = {
    "en": ("Thanks for your question.", "I appreciate that you ask.", "I know that this (matters|is important).", "(Perhaps|Maybe) (an expert|someone else|a professional) can help.", "Is there anything else I can do?", "I hope (that|this) is all right."),
    "de": ("Danke für die Nachricht.", "Ich weiß, dass das wichtig ist.", "(Vielleicht|Womöglich) hilft (ein Fachmann|eine Expertin|jemand anderes).", "Kann ich sonst etwas tun?", "Ich hoffe auf Verständnis."),
    "fr": ("Merci (pour votre question|de votre message).", "Je sais que c'est important.", "(Un expert|Une spécialiste) pourra peut-être aider.", "Puis-je faire autre chose ?", "Merci de votre compréhension."),
    "es": ("Gracias por (la pregunta|preguntar).", "Sé que esto es importante.", "(Un experto|Una especialista) quizá pueda ayudar.", "¿Puedo hacer otra cosa?", "Gracias por la comprensión."),
    "pt": ("Obrigado por perguntar.", "Sei que isso é importante.", "Talvez (um especialista|uma profissional) possa ajudar.", "Posso fazer outra coisa?", "Agradeço a compreensão."),
    "zh": ("谢谢提问。", "我知道这很重要。", "也许(专家|别人)可以帮忙。", "还有别的事吗？", "请见谅。"),
}
_CHOICE = re.compile(r"\(([^()]*)\)")


def _said(rule: str, rnd: random.Random, name: str) -> str:
    return _CHOICE.sub(lambda m: rnd.choice(m[1].split("|")), rule).replace("{x}", name)


def made_refusal(lang: str, rnd: random.Random, name: str, held: bool | None = None) -> str:
    """A refusal of the grammar; with ``held`` true by the held-out rules only, with false without them."""
    rules = _REFUSALS[lang] if held is None else _REFUSALS[lang][-1:] if held else _REFUSALS[lang][:-1]
    parts = [_said(rnd.choice(rules), rnd, name)]
    if rnd.random() < 0.25:
        parts.append(_said(rnd.choice(rules), rnd, name))
    if rnd.random() < 0.4:
        parts.insert(0, _said(rnd.choice(_SOFTENERS[lang]), rnd, name))
    if rnd.random() < 0.4:
        parts.append(_said(rnd.choice(_SOFTENERS[lang]), rnd, name))
    return ("" if lang == "zh" else " ").join(parts)


# Short but complete answers.
_SHORT = {
    "en": ("Yes.", "No.", "Only once.", "No, not yet.", "On Monday."), "de": ("Ja.", "Nein.", "Nur einmal.", "Nein, noch nicht."), "fr": ("Oui.", "Non.", "Une seule fois.", "Non, pas encore."),
    "es": ("Sí.", "No.", "Solo una vez.", "No, todavía no."), "pt": ("Sim.", "Não.", "Só uma vez.", "Não, ainda não."), "zh": ("是的。", "不是。", "只有一次。", "还没有。"),
}
_TAG = re.compile(r"<[^<>\n]{1,30}>")
_EMPTY = ("<br>", "<p></p>", "", " ", "\n", " \t", "​", "...", "…", "-", "- \n- ", "```\n```", "\n\n", "***", "**", "> ", "| |", "—", "#", "()", "[]", "•")
_LABELS = {
    "en": ("Answer:", "Response:"), "de": ("Antwort:",), "fr": ("Réponse :", "Réponse:"), "es": ("Respuesta:",), "pt": ("Resposta:",), "zh": ("回答：", "答：", "答复："),
}


def _place(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % PLACES


def _ending(a: str) -> tuple[float, ...]:
    """How an answer ends: proper end, unclosed constructs, broken rows, a bare word, a comma."""
    s = a.rstrip()
    lines = s.split("\n")
    last_line = lines[-1].strip() if s else ""
    bare = s.rstrip("".join(_CLOSING) + " \t\n") if s else ""
    end, core = (s[-1] if s else ""), (bare[-1] if bare else "")
    open_fence = s.count("```") % 2
    closed_fence = float(s.endswith("```") and not open_fence)
    rows = [x for x in lines if x.lstrip().startswith("|")]
    is_row = last_line.startswith("|") and len(last_line) > 1
    whole_row = is_row and last_line.endswith("|") and bool(rows) and last_line.count("|") == rows[0].count("|")
    text = re.sub(r"```.*?```", "", s, flags=re.S)
    unclosed = float(
        text.count("[[") > text.count("]]") or text.count("(") > text.count(")") or text.count("（") > text.count("）")
        or text.count("**") % 2 or text.count("`") % 2
    )
    symbol = float(bool(end) and not end.isalnum() and ord(end) > 0x2190 and end not in "。！？…）】」』，、：；")
    link = float(s.endswith("]]") and text.count("[[") == text.count("]]"))
    digit_stop = float(len(s) > 1 and end == "." and s[-2].isdigit())
    terminal = float(end in _TERMINAL or (core in _TERMINAL and end in _CLOSING))
    broken = open_fence or unclosed or (is_row and not whole_row)
    proper = float(not broken and bool(terminal or closed_fence or whole_row or link or symbol))
    return (
        proper,
        float(open_fence),
        unclosed,
        float(is_row and not whole_row),
        float(end.isalnum()),
        float(bool(end) and end in ",;:，；：、-–—("),
        digit_stop,
        terminal,
    )


def _overlap(q: list[str], a: list[str]) -> tuple[float, ...]:
    """Whether an answer only gives the question back: shares of words, pairs of words and lengths."""
    if not q or not a:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    sq, sa = set(q), set(a)
    bq, ba = set(zip(q, q[1:])), set(zip(a, a[1:]))
    new = sum(w not in sq for w in a) / len(a)
    return (
        len(sq & sa) / len(sa),
        len(sq & sa) / len(sq),
        len(bq & ba) / max(1, len(ba)),
        new,
        float(new < 0.1 and len(a) <= 1.1 * len(q) + 2),
    )


def said(a: str) -> str:
    """What an answer says itself: without quoted lines and phrases, unless nothing else is left."""
    rest = re.sub(r"(?m)^[ \t]*>.*$", " ", a)
    rest = langid._QUOTED.sub(" ", rest) if any(c in rest for c in "\"“„«「『") else rest
    return rest if any(c.isalnum() for c in rest) else a


def pair_features(q: str, a: str, lang_q: tuple, lang_a: tuple) -> tuple[list[float], list[int]]:
    """Dense features and places of the hashed n-grams of a pair; ``lang_*`` are results of the language model."""
    wq, wa = _WORD.findall(q.lower()), _WORD.findall(a.lower())
    content = sum(c.isalnum() for c in _TAG.sub("", a))
    bare = a.strip().strip("*_# ")
    # a few Latin words tell no language; Han characters do
    telling = len(wa) >= 6 or any("一" <= w <= "鿿" for w in wa) != any("一" <= w <= "鿿" for w in wq)
    other = telling and bool(lang_a[0]) and bool(lang_q[2]) and not set(lang_a[2]) & set(lang_q[2])
    asked = bool(_LANGUAGE_NAME.search(q)) and bool(_ASKS.search(q))
    dense = [
        1.0,
        float(content == 0),
        float(content > 0 and len(wa) <= 2 and bare[-1:] in ":："),
        min(len(wa), 60) / 60,
        *_ending(a),
        float(len(wa) <= 6),
        *_overlap(wq, wa),
        float(other),
        float(other and not asked),
        float(other and not asked and lang_a[1] > 0.9 and len(wa) >= 3),
        float(asked),
    ]
    own = _WORD.findall(said(a).lower())
    grams = [*own, *(f"{x} {y}" for x, y in zip(own, own[1:])), *(f"{x} {y} {z}" for x, y, z in zip(own, own[1:], own[2:]))]
    return dense, [_place(g) for g in grams]


# Which dense features a defect's classifier sees, by index, beside the n-grams that all of them see, and how many steps fit these.
_SEES = {
    "empty": ([0, 1, 2, 3, 12], 20),
    "truncated": ([0, 1, 2, 3, 4, 10, 12, 17], 20),
    "refusal": ([0, 3, 12], 250),
    "copy": ([0, 1, 3, 12, 13, 14, 15, 16, 17], 20),
    "wrong_language": ([0, 1, 12, 17, 18, 19, 20, 21], 20),
}


class Classifier:
    """One linear classifier for each defect, with its threshold."""

    def __init__(self, dense, hashed, thresholds, languages: langid.Model):
        self.dense, self.hashed, self.thresholds, self.languages = dense, hashed, thresholds, languages

    def scores(self, dense, grams):
        """Log odds of each defect, of rows of dense features and lists of places."""
        import numpy as np

        out = np.asarray(dense) @ self.dense
        for i, g in enumerate(grams):
            if g:
                out[i] += self.hashed[g].sum(axis=0) / len(g)
        return out


def _featured(pairs: list[tuple[str, str]], who: langid.Identifier):
    lq, la = who.records([q for q, _ in pairs]), who.records([a for _, a in pairs])
    both = [pair_features(q, a, x, y) for (q, a), x, y in zip(pairs, lq, la, strict=True)]
    return [d for d, _ in both], [g for _, g in both]


def _drop_words(text: str, rnd: random.Random) -> str:
    words = text.split(" ")
    kept = [w for w in words if rnd.random() > 0.2] or words[:1]
    return " ".join(kept)


def synthetic(
    pairs: list[tuple[str, str]], langs: list[str], rnd: random.Random, held_rules: bool | None = None
) -> list[tuple[str, str, str]]:
    """``(question, answer, defect)``: a spoilt copy of each kind for sound pairs of known language."""
    by_lang: dict[str, list[str]] = {}
    for (_, a), lang in zip(pairs, langs, strict=True):
        by_lang.setdefault(lang, []).append(a)
    out = []
    for (q, a), lang in zip(pairs, langs, strict=True):
        out.append((q, rnd.choice(_EMPTY) if rnd.random() < 0.7 else rnd.choice(_LABELS[lang]) + rnd.choice(("", " ", "\n")), "empty"))
        if len(a) > 30:
            body = a[: rnd.randrange(len(a) // 4, len(a) - 2)].rstrip()
            if body and body[-1] not in _TERMINAL and not body.endswith(("]]", "|", "```")):
                out.append((q, body, "truncated"))
        name = next((w for w in re.findall(r"[A-Z]\w+", q)[1:]), "") or re.sub(r"[^一-鿿]", "", q)[3:6] or "X"
        refusal = made_refusal(lang, rnd, name, held_rules)
        out.append((q, rnd.choice((refusal, refusal, f"> {q}\n\n{refusal}", f"{name}: {refusal}")), "refusal"))
        forms = (q, q.upper(), q.lower(), f"> {q}\n", f"**{q}**", q.rstrip("?？ ") + rnd.choice((".", "…", "", "?")), "  ".join(q.lower().split()) + "…", _drop_words(q, rnd), q + "\n", f'"{q}"')
        if q.strip():
            out.append((q, rnd.choice(forms), "copy"))
        if rnd.random() < 0.3:
            out.append((q, rnd.choice(_SHORT[lang]), ""))
        others = [x for x in by_lang if x != lang]
        if others and not _LANGUAGE_NAME.search(q):
            out.append((q, rnd.choice(by_lang[rnd.choice(others)]), "wrong_language"))
        # quotes of the question or of a refusal that go on are sound
        if rnd.random() < 0.3:
            out.append((q, rnd.choice((f"> {q}\n\n{a}", f'"{refusal}" — {a}', f"{q} {a}", f"{a}\n\n> {refusal}")), ""))
    return out


def _logistic(x, y, l2: float, steps: int = 60):
    """Weights of a logistic regression by Newton's method, on few dense features."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _logistic_hashed(x, bag, y, w, steps: int, rate: float = 0.5, l2: float = 1e-6):
    """The same with mean-pooled hashed n-grams, by AdaGrad over the whole sample, from the weights ``w`` of the dense features on."""
    import numpy as np

    flat, owner, per = bag
    v, w = np.zeros(PLACES), w.copy()
    gw, gv = np.full(x.shape[1], 1e-8), np.full(PLACES, 1e-8)
    for _ in range(steps):
        z = x @ w + np.bincount(owner, v[flat], len(y)) * per
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        dw = x.T @ d + l2 * w
        dv = np.bincount(flat, (d * per)[owner], PLACES) + l2 * v
        gw += dw * dw
        gv += dv * dv
        w -= rate * dw / np.sqrt(gw)
        v -= rate * dv / np.sqrt(gv)
    return w, v


def _bag(grams):
    """(places, their rows, one over the number of each row's places)."""
    import numpy as np

    lens = np.array([len(g) for g in grams])
    flat = np.fromiter((p for g in grams for p in g), np.int64, lens.sum())
    return flat, np.repeat(np.arange(len(grams)), lens), 1.0 / np.maximum(1, lens)


def _threshold(scores, y) -> float:
    """The cut of the best F1 on held-out rows; in the middle of the gap it falls in."""
    import numpy as np

    order = np.argsort(-scores)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    k = int(f1.argmax())
    nxt = scores[order[k + 1]] if k + 1 < len(y) else scores[order[k]] - 2
    return float((scores[order[k]] + nxt) / 2)


def train(sample: list[tuple[str | None, str | None]], languages: langid.Model, seed: int = 7, held_rules: bool | None = None) -> Classifier:
    """Fit on sampled pairs and their spoilt copies.

    The sample holds defective pairs of its own, which would count as sound: those that score as high as the made cases but for the lowest
    tenth, by a classifier of few steps, are left out of the next fit. Every fourth pair is held out, with its copies, for the thresholds. With ``held_rules=False`` refusals are made without the rules held out for measuring.
    """
    import numpy as np

    who = langid.Identifier(languages)
    pairs = [(q or "", a or "") for q, a in sample]
    clf, suspect = None, None
    for share in (0.1, 0.25, 1.0):
        if clf is not None:
            dense, grams = _featured(pairs, who)
            sound = (clf.scores(dense, grams) < np.minimum(clf.thresholds, suspect)).all(axis=1)
            kept = [p for p, ok in zip(pairs, sound, strict=True) if ok]
            pairs = kept if len(kept) >= 20 else pairs
        else:
            pairs = [p for p in pairs if sum(c.isalnum() for c in p[1]) > 0]
        rnd = random.Random(seed)
        judged = who.records([a for _, a in pairs])
        known = [(p, j[0]) for p, j in zip(pairs, judged, strict=True) if j[0] in _REFUSALS]
        rows, held = [(q, a, "") for q, a in pairs], [i % 4 == 0 for i in range(len(pairs))]
        for i, (p, lang) in enumerate(known):
            made = synthetic_for(p, lang, known, rnd, held_rules)
            rows += made
            held += [i % 4 == 0] * len(made)
        dense, grams = _featured([(q, a) for q, a, _ in rows], who)
        x, out = np.array(dense), np.array(held)
        bag, every = _bag([g for g, o in zip(grams, out, strict=True) if not o]), _bag(grams)
        weights, hashed, cuts, suspect = np.zeros((x.shape[1], len(DEFECTS))), np.zeros((PLACES, len(DEFECTS))), [], np.full(len(DEFECTS), np.inf)
        for k, defect in enumerate(DEFECTS):
            y = np.array([d == defect for _, _, d in rows], float)
            cols, steps = _SEES[defect]
            steps = int(np.ceil(steps * share))
            start = _logistic(x[~out][:, cols], y[~out], 0.1)
            # few steps from the dense weights on where n-grams hardly tell, so that they only correct
            weights[cols, k], hashed[:, k] = _logistic_hashed(x[~out][:, cols], bag, y[~out], start, steps, 0.5 if defect == "refusal" else 0.05)
            z = x @ weights[:, k] + np.bincount(every[1], hashed[every[0], k], len(x)) * every[2]
            cuts.append(_threshold(z[out], y[out]) if y[out].any() else np.inf)
            if y[out].any():
                suspect[k] = np.quantile(z[out & (y > 0)], 0.1)
        clf = Classifier(weights, hashed, np.array(cuts), languages)
    return clf


def synthetic_for(
    pair: tuple[str, str], lang: str, known: list, rnd: random.Random, held_rules: bool | None = None
) -> list[tuple[str, str, str]]:
    """The spoilt copies of one pair; the swapped answer is drawn from all of another language."""
    other = rnd.choice(known)
    near = [(pair, lang)] + ([other] if other[1] != lang else [])
    made = synthetic([p for p, _ in near], [x for _, x in near], rnd, held_rules)
    return [m for m in made if m[0] == pair[0]]


def fit(pairs: DataFrame, languages: langid.Model, sample_pairs: int = SAMPLE_PAIRS) -> Classifier:
    """:func:`train` on a bounded sample, picked by a hash."""
    some = langid.picked(pairs, F.hash("question_id", "answer_id"), sample_pairs, "pairs").select("question", "answer").toArrow()
    rows = sorted(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True), key=lambda r: (r[0] or "", r[1] or ""))
    return train(rows, languages)


_WORKER: dict = {}


def defects(pairs: DataFrame, clf: Classifier) -> DataFrame:
    """``question_id, answer_id, defect``: the defective pairs, each with the first defect that applies.

    The order is empty, copy, refusal, wrong_language, truncated. Map-only. Null answers are empty; with a null or empty
    question an answer can be neither a copy nor of a wrong language.
    """
    handle = langid._Handle(pairs.sparkSession.sparkContext.broadcast(clf))
    order = [DEFECTS.index(d) for d in ("empty", "copy", "refusal", "wrong_language", "truncated")]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if _WORKER.get("id") != handle.id:
            _WORKER.update(id=handle.id, clf=handle.value, who=langid.Identifier(handle.value.languages))
        own, who = _WORKER["clf"], _WORKER["who"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                qs, answers = part.column(2).to_pylist(), part.column(3).to_pylist()
                dense, grams = _featured([(q or "", a or "") for q, a in zip(qs, answers, strict=True)], who)
                over = own.scores(dense, grams) >= own.thresholds
                first = [next((DEFECTS[k] for k in order if row[k]), None) for row in over]
                keep = pa.array(np.array([f is not None for f in first], bool))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(keep), part.column(1).filter(keep), pa.array([f for f in first if f], pa.string())],
                    ["question_id", "answer_id", "defect"],
                )

    types = {c: pairs.schema[c].dataType.simpleString() for c in ("question_id", "answer_id")}
    return pairs.select("question_id", "answer_id", "question", "answer").mapInArrow(
        run, f"question_id {types['question_id']}, answer_id {types['answer_id']}, defect string"
    )
