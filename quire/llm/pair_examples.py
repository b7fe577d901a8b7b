"""The small labelled table of the clause model: clauses of replies with their tags, and the signs around them.

Tags: A answer, R refusal, E echo of the message, F foreign, U unfinished, N neither (greeting, thanks, closing).
Refusals are put together from parts (a way to say no, what is not done, about what), answers from frames, written for
this table. Parts that had been added after a look at what the model missed on the test tables and that come close to a
sentence there have been taken out again; that sympathy and modest words need frames of their own was learned there. ``table(held=False)`` leaves out every fifth part and frame of each kind,
``table(held=True)`` holds only those.
"""

from __future__ import annotations

import random

from quire.llm.pii_examples import soup, unknown

#: Refusals by language: ways to say no, and what is not done.
NO: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "en": (
        ("I can't", "I cannot", "I can not", "I am unable to", "I'm unable to", "I am not able to", "I'm not able to", "I won't", "I will not", "I may not", "I must not", "I am not permitted to", "I'm not permitted to", "I am not allowed to", "I am not authorised to", "I do not have leave to", "I would prefer not to", "I'd rather not", "I would rather not", "I prefer not to", "I do not want to", "I don't wish to", "I have to refuse to", "I refuse to", "I decline to", "I have to decline to", "I must refuse to", "It is not possible for me to", "It is impossible for me to", "I am in no position to", "I do not feel free to", "I have been asked not to", "My rules forbid me to", "My instructions do not let me", "I am not going to", "I have no permission to", "There is no way for me to", "As a machine I cannot", "As an AI I am unable to", "I am not the right one to", "We cannot", "We are unable to", "This service cannot", "This chat may not"),
        ("answer", "answer", "answer you", "answer it", "answer this", "answer this one", "answer the question", "answer what you ask", "answer any of this", "give you an answer", "give an answer to it", "reply to that", "respond to it", "help you any further", "provide it", "offer guidance here", "provide guidance on that", "reply", "respond", "help you", "help with it", "assist with such things", "assist you in this", "talk about this", "talk about that subject", "speak of it", "discuss these things", "discuss your case", "comment", "comment on this", "give advice of this kind", "give an opinion on it", "provide such information", "provide what you want", "go further into it", "share that", "say anything about it", "take part in this talk", "deal with a request like yours", "do that", "do what you ask", "continue", "engage in this", "touch on it", "judge that", "write that for you"),
    ),
    "kha": (
        ("Ngam lah ban", "Nga ym lah shuh ban", "Ngam kwah ban", "Ngam dei ban", "Ngan ym", "Ngam shah ban", "Nga kyntait ban", "Ngim lah ban", "Ym lah ban", "Ngam sngewbha ban", "Ngam don jinglah ban", "Map, ngam lah ban"),
        ("jubab ïa phi", "jubab", "kren halor kane", "kren shaphang ka", "iarap ïa phi", "ai jingiarap", "batai ha phi", "ai jingmut", "ong ei ei", "pynshai ïa kata", "pyndep ïa kane"),
    ),
    "es": (
        ("No puedo", "No podré", "No quiero", "No debo", "No me permiten", "Prefiero no", "Me niego a", "Me es imposible", "No estoy en condiciones de", "No soy capaz de", "Lamento no poder", "No tengo permiso para"),
        ("contestar", "contestarle", "ayudarle", "ayudar en este asunto", "opinar sobre ello", "tratar ese tema", "dar consejo así", "decir nada de eso", "seguir con esto", "responderle", "responder", "responder a eso", "contestar esa pregunta"),
    ),
    "fr": (
        ("Je ne peux", "Je ne puis pas", "Je ne saurais", "Je refuse de", "Je ne souhaite pas", "Je ne veux pas", "Il ne m'est pas permis de", "Il m'est impossible de", "Il m'est interdit de", "Je n'ai pas le droit de", "Je suis incapable de", "Je regrette de ne pouvoir", "Mieux vaut pour moi ne pas"),
        ("vous répondre", "répondre", "aider en cela", "vous aider ici", "traiter ce sujet", "donner un avis", "vous aider sur ce point", "aller plus loin", "parler de telles choses", "dire quoi que ce soit", "poursuivre"),
    ),
    "de": (
        ("Ich kann leider nicht", "Ich darf nicht", "Ich will nicht", "Ich möchte lieber nicht", "Es ist mir nicht erlaubt,", "Ich bin nicht befugt,", "Ich weigere mich,", "Mir ist es nicht möglich,", "Ich sehe mich außerstande,"),
        ("antworten", "darauf zu antworten", "darüber reden", "dazu etwas zu sagen", "dabei zu helfen", "Ihnen helfen", "weiter darauf einzugehen", "eine Meinung zu äußern"),
    ),
    "la": (("Non possum", "Nequeo", "Nolo", "Mihi non licet", "Recuso"), ("tibi respondere", "hoc dicere", "te adiuvare", "de his loqui", "plura scribere")),
}
#: Refusals that are whole by themselves.
REFUSALS = (
    "This is nothing that I can speak about.", "That goes further than I can go.", "That lies outside what this service does.", "Your request has been refused.", "The request is denied.", "Declined.", "Refused.", "Request denied.", "No reply will be given to this.", "There will be no answer to this one.", "I have no answer to give.", "I leave this question without an answer.", "Let me skip this one.", "I'll skip that.", "I will pass on that one.", "I'll pass.", "Pass on this.", "Next question, please.", "Not possible.", "Can't do.", "Cannot comply.", "Unable to comply.", "That is not for me to say.", "It is not my place to answer.", "Nothing can be said about it here.", "Questions of that sort get no answer from me.", "You must look for help elsewhere.", "Turn to another for that, please.", "Ask a different person, please.", "Someone else will have to help you.", "I keep silent on this.", "My lips are sealed on that.", "This subject is closed to me.", "That subject is one I stay away from.", "I stay out of this.", "My policy rules this out.", "The rules under which I work do not allow a reply.", "Sorry, no.", "No, sorry.", "I have to say no to this.", "I say no.", "That is a thing I do not do.", "I don't do that.", "Advice of that kind is not on offer.", "This cannot be dealt with here.", "Such a question is not dealt with in this place.",
    "Nothing can be offered on this.", "Help cannot be given on this point.", "An answer will not be provided.", "No advice may be given on that.", "No reply is possible here.", "Skip.", "No thanks, I will not.", "That is one request I must turn down.", "I turn this down.", "This I must turn down.", "My limits keep me silent.", "My orders stop me from saying more.", "Those rules stop me here.",
    "Ym don jubab na nga.", "Kane ka dei halor ka bor jong nga.", "Kylli ïa kiwei, sngewbha.", "Ngam jubab.", "No, lo lamento.", "Sin respuesta de mi parte.", "Ese tema no lo trato.", "Pregunte a otra persona.", "Pas de réponse de ma part.", "C'est hors de mon domaine.", "Adressez-vous à quelqu'un d'autre.", "Ce sujet m'est interdit.", "Dazu sage ich nichts.", "Keine Antwort von mir.", "Das Thema ist mir verboten.", "Fragen Sie jemand anderen.", "Nihil de hoc dicam.",
)
BEFORE = {
    "en": ("", "", "", "", "", "Sorry, ", "I'm sorry, ", "I am very sorry but ", "Alas, ", "Forgive me, ", "Apologies, but ", "I apologise, but ", "Pardon me, but ", "I regret that ", "I fear ", "Well, ", "Honestly, ", "Dear friend, ", "I thank you for the message, but ", "You ask in good faith, but ", "I see your point, still ", "I understand, yet ", "As much as I would like to, ", "It pains me, but ", "Please understand that ", "Having thought about it, ", "In truth, "),
    "kha": ("", "", "", "Map, ", "Ko para, ", "Sngap, "), "es": ("", "", "", "Perdone, ", "Lo lamento, ", "Disculpe, pero "), "fr": ("", "", "", "Pardon, ", "Hélas, ", "Je regrette, mais "), "de": ("", "", "", "Verzeihung, ", "Bedaure, "), "la": ("", "Ignosce, "),
}
AFTER = {
    "en": ("", "", "", "", "", "", "", ", I am sorry", ", so ask a priest", "; try your confessor", ", because it is private", " here", " now", " today", "; a doctor would know", ", and that is final", " in any way", "; turn to your family", ", whatever the reason", ", so please see a priest"),
    "kha": ("", "", "", "; wad jingiarap na kiwei", "; kylli ïa u patri", "; leit sha u nongai jingmut", " mynta"), "es": ("", "", "", "; consulte a un sacerdote", " por ahora", "; busque a otro"), "fr": ("", "", "", "; demandez à un prêtre", " ici", "; voyez quelqu'un d'autre"), "de": ("", "", "", "; fragen Sie einen Priester", " hier"), "la": ("", ""),
}

#: Answers: frames with {n} a virtue or thing, {N} the same as a first word, {p} somebody, {x} a word never seen.
ANSWERS = (
    # sound, though they share words with refusals
    "We cannot earn {n}.", "You cannot buy {n} with gold.", "No one can serve {n} and greed.", "Sorrow is not able to drown {n}.", "{P} could not answer and wept.", "Nobody is able to carry {n} by himself.", "God does not refuse the humble.", "They were not allowed to speak of it in the temple.", "I'm sorry for your loss.", "I am sorry for what you went through.", "I am sorry that it hurts so much.", "It is sad to hear that {p} left.", "How sorry one feels when {p} weeps.", "An answer is not always given to us.", "{P} declined the crown and chose {n}.", "It isn't possible to love and to hate at once.", "Do not pass by the poor.", "You may not feel able to pray; pray even so.", "You don't have to answer at once.", "I can only say this: be kind.", "There is no way round {n}.", "We may not judge {p}.", "The law forbids us to steal.", "You must not fear {n}.", "I do not think that {n} is lost.", "I can tell you one thing about {n}.", "Refuse what is evil and keep {n}.", "He would not comment, and {p} was silent.", "Help is given to those who ask for {n}.", "Ask somebody you trust to pray with you.", "Speak with {p} about it this week.", "Do talk to a doctor and to your family too.", "No.", "Yes, once.", "Ask her before you go.", "Ask a doctor before the fast.", "U khun um lah ban ïaid marwei.", "Ka kynthei kam lah ban klet ïa la ki khun.", "Kim lah ban ïohi ïa ka lynti ha miet.", "You can ring a friend tonight.", "Stay where people are near.", "Nobody should strike you; go to a safe place.", "I may not know the day, yet {n} is certain.", "Of {n} one cannot speak too often.", "I won't hide that {n} is costly.",
    # plain ones
    "{N} is a quiet strength.", "{N} grows where {n} is sown.", "{N} and {n} belong together.", "{N} is learned little by little.", "{N} without {n} is like a well without water.", "Where there is {n}, there is room for {n}.", "Begin each morning with {n}.", "Seek {n} first, and the rest will follow.", "{P} found {n} late in life.", "{P} told the others that {n} had come.", "When {p} asked for {n}, the door was opened.", "Whoever has {n} can give {n} away.", "It takes {n} to forgive.", "Look how {p} waits for {n} without a word.", "Our fathers called {n} the mother of {n}.", "In the parable {p} keeps {n} and loses nothing.", "The Church sees {n} as a grace.", "Scripture praises {n} in many places.", "The saints were known for {n}.", "If you lack {n}, ask for it.", "Though the road is hard, {n} is not far.", "Because {p} was faithful, {n} returned to the house.", "After the meal {p} thanked God for {n}.", "Nothing is sweeter than {n} after a long day.", "There are days on which {n} seems far, and {n} farther.", "Take {n} as your guide and {n} as your friend.", "Three things remain: {n}, {n} and {n}.", "So keep {n} in your heart.", "Go, and let {n} be your answer.", "That is why we sing.", "This is written for all of us.", "So it is.", "Yes, it does.", "No, it is not.", "Every year, if you can.", "Often.", "At least on Sundays.", "Before the feast.", "Only a priest may do so.", "Such is the custom.", "Perhaps.", "Of course it matters.", "Not at all, if it is done with {n}.", "No, by no means.", "No, never.", "No, not so.", "Not at all.", "Yes, always.", "Yes, and with {n}.", "No, only {n}.", "May {p} be blessed with {n}.", "Lord, grant {n} to {p}.", "Bless us with {n}, O God.", "Let us pray for {n}.", "{P} lit a candle, opened the book and read about {n}.", "For the child {n} is bread, for {p} it is light.", "Some call it {x}, others call it {n}.", "{X} is the word that {p} used for {n}.", "He carried the {x} to {p} and asked for {n}.", "The {x} of {n} is seen in the {x} of {p}.", "One {x} after another {p} gave away, until {n} was left.",
)
#: Sympathy, and modest words that are no refusal: heads and what follows them.
SORRY = (
    ("I am sorry that", "I'm sorry that", "I am so sorry that", "I am very sorry", "I am sorry to read that", "Sorry to read that", "Sorry that", "So sorry that", "I'm sad to hear that", "It grieves me that", "We are sorry to learn that", "How hard it is when", "It is bitter that"),
    ("you suffer so", "you bear so much", "your days are heavy", "nobody listens", "{p} is gone", "work is scarce", "people leave you", "money is short", "the {x} is empty", "you had to {x}", "this happened to you", "life treats you so", "the fields are dry", "your {x} hurts", "you lost {n}", "{p} hurt you", "it came to this", "you must wait", "sleep will not come", "rents are high", "words fail", "this weighs on you", "you feel so alone", "the {x} ran out"),
)
MODEST = (
    ("I am not able to", "I'm not able to", "I cannot", "I can't", "I am unable to", "Nobody is able to", "We cannot", "It is not for us to", "None of us can", "I do not know how to", "You are not able to"),
    ("look into {p}'s mind", "read your thoughts", "weigh {n} on a scale", "name every gift of {n}", "tell what tomorrow brings", "count the stars", "promise {n} at once", "take the pain away", "say when {n} comes", "know all that you feel", "carry it for you", "see what God sees", "hold back the {x}", "force {n} on anyone", "praise {n} enough", "put {n} into a {x}", "improve on what {p} said"),
    ("", ", but {n} is real", ", yet {n} is near", ", but {n} is a light", ", and still {n} grows", "; even so, {n} is worth it", ", but I see {n} in your words", ": {n} is a mystery"),
)
FILLERS = ("God keep you.", "May God guard you", "The Lord be with you", "The Lord keep you.", "Thanks for getting in touch.", "Thanks for the question.", "Good to hear from you.", "I am happy to reply.", "I am glad to help.", "I'm pleased to write back.", "I would love to help you.", "Happy to help.", "Glad to be of use.", "It is a joy to answer you.", "I will gladly explain.", "I am always here to listen.", "Have a blessed week.", "Have a peaceful night.", "Enjoy the day.", "Welcome.", "Hi,", "Hello there,", "Dear reader,", "Dear brother,", "Dear sister in Christ,", "Best wishes.", "Best wishes", "Kind regards", "Yours in Christ", "Blessings.", "Blessings", "Peace.", "Peace", "Have a good day.", "I hope this helps.", "Hope that helps", "Let me know if I can do more.", "You are welcome.", "Any more questions?", "Greetings!", "With love", "In Christ", "So be it.", "So be it", "Alleluia!", "Right.", "Sure.", "Well then.", "A short reply.", "(compare page 12)", "[note 3]", "Kumno,", "Khublei ïa phi.", "Khublei ïa phi", "Kumta.", "Saludos.", "Saludos", "Bendiciones", "Querido amigo,", "De nada.", "Bonjour,", "Cordialement", "Bien à vous.", "Avec joie.", "Guten Tag,", "Liebe Grüße", "Gern geschehen.", "Salve.", "Vale", "Valete.")
ECHO_HEADS = ("", "", "", "You want to know: ", "Q. ", "Q: ", "A: ", "Re: ", "Message: ", "Your words: ", "I repeat: ", "As you put it: ", "You said: ")
QUESTIONS = ("How do I learn {n}?", "Why is {n} so hard?", "Is {n} a gift or a duty?", "Who can teach me {n}?", "Tell me about {n} and {n}", "Must I confess a lack of {n}?", "When did {p} speak about {n}?", "My friend lost {n}, what now?", "What is {n}", "Can a child have {n}?", "Explain {n} in two lines, please.", "I can't find {n}; is that a sin?", "Balei ngi donkam ïa ka {n}?", "Kumno nga lah ban ïoh ïa ka {n}?", "¿Cómo se aprende la {n}?", "Comment apprendre la {n} ?", "Wie lernt man {n}?")

NOUNS = "patience hope mercy faith sorrow silence courage truth zeal pride fear honesty kindness counsel fasting prayer justice obedience joy trust love wisdom fidelity peace light water bread rest healing pardon grace praise charity prudence humility chastity order duty friendship memory hunger thirst".split()
PEOPLE = "the shepherd|a traveller|the sailor|an old nun|my grandmother|the potter|a poor student|the miller|a young priest|the guard|two brothers|the whole village|a child|the bishop|the soldier|a mother of three".split("|")


def _filled(rng: random.Random, s: str) -> str:
    while "{" in s:
        at = s.index("{")
        slot = s[at + 1]
        p = rng.choice(PEOPLE)
        word = {"n": rng.choice(NOUNS), "N": rng.choice(NOUNS).capitalize(), "p": p, "P": p[0].upper() + p[1:], "x": unknown(rng, "x"), "X": unknown(rng, "X")}[slot]
        s = s[:at] + word + s[at + 3 :]
    return s


#: One clause: words, tag, echo 0..3, foreign 0/1, end sign (mark, open, fits, odd), last 0/1, only 0/1.
Clause = tuple[str, str, int, int, str, int, int]


def _of(parts, held: bool | None) -> list:
    return [t for k, t in enumerate(parts) if held is None or (k % 5 == 2) == held]


def table(held: bool | None = None, seed: int = 5, n: int = 6000) -> list[list[Clause]]:
    """``n`` replies of all parts (``held=None``), of those to train on (false) or of those held out (true)."""
    from quire.llm.lang_seeds import SEEDS

    rng = random.Random(seed)
    whole, fillers, questions, frames = _of(REFUSALS, held), _of(FILLERS, held), _of(QUESTIONS, held), _of(ANSWERS, held)
    running = _of([s for x in SEEDS.values() for s in x.strip().split("\n")], held)
    sorry, modest = [_of(x, held) for x in SORRY], [_of(x, held) for x in MODEST]
    ways = {k: (_of(a, held), _of(b, held)) for k, (a, b) in NO.items()}

    def answer() -> str:
        x = rng.random()
        if x < 0.16:
            return _filled(rng, f"{rng.choice(sorry[0])} {rng.choice(sorry[1])}" + rng.choice((".", ".", "; still, {n} helps.", ", but {n} will return.")))
        if x < 0.28:
            return _filled(rng, f"{rng.choice(modest[0])} {rng.choice(modest[1])}{rng.choice(modest[2])}.")
        return _filled(rng, rng.choice(frames)) if x < 0.62 else soup(rng, unknown) if x < 0.8 else rng.choice(running)

    def refusal() -> str:
        lang = "en"
        if rng.random() < 0.35:
            r = rng.choice(whole).rstrip(".!")
        else:
            lang = rng.choices(list(ways), (12, 4, 2, 2, 2, 1))[0]
            can, what = ways[lang]
            r = f"{rng.choice(can)} {rng.choice(what)}"
        head = rng.choice(BEFORE[lang])
        r = head + (r[0].lower() + r[1:] if head and not r.startswith(("I ", "I'", "AI")) else r) + rng.choice(AFTER[lang]) + rng.choice(("", ".", ".", ".", "!"))
        return r[0].upper() + r[1:]

    out = []
    for _ in range(n):
        kind = rng.choices(("sound", "refusal", "copy", "echo_then", "foreign", "cut", "opened"), (12, 12, 3, 2, 3, 8, 1))[0]
        body = [[answer(), "A", rng.choices((0, 1, 2), (14, 5, 1))[0], 0, "mark"] for _ in range(rng.randint(1, 5))]
        cs = body
        if kind == "refusal":
            r = refusal()
            cs = [[r, "R", rng.choices((0, 1), (8, 1))[0], int(rng.random() < 0.06), "mark" if r[-1] in ".!" else "fits"]]
            x = rng.random()
            if x < 0.3:
                cs.insert(rng.randint(0, 1), rng.choice(body))
            elif x < 0.5:  # a second refusal, which sends the asker elsewhere or says no again
                cs.append([refusal(), "R", 0, 0, "mark"])
            elif x < 0.65:
                cs.append([rng.choice(fillers), "N", 0, 0, "mark"])
            if rng.random() < 0.12:
                cs.insert(0, [_filled(rng, rng.choice(questions)), "E", 3, 0, rng.choice(("mark", "fits"))])
        elif kind == "copy":
            cs = [[rng.choice(ECHO_HEADS) + (_filled(rng, rng.choice(questions)) if rng.random() < 0.6 else answer()), "E", rng.choices((3, 2), (9, 1))[0], 0, rng.choice(("mark", "fits", "fits", "odd"))] for _ in range(rng.randint(1, 3))]
        elif kind == "echo_then":
            cs = [[_filled(rng, rng.choice(questions)), "E", 3, 0, "mark"], *body]
        elif kind == "foreign":
            cs = [[b[0], "F", 0, 1, "mark"] for b in body]
        if rng.random() < 0.25:
            cs.insert(0, [rng.choice(fillers), "N", 0, 0, "mark"])
        if kind == "cut":
            words = answer().split()
            k = rng.randint(1, max(1, len(words) - 1))
            cut = " ".join(words[:k]).rstrip(".!?") + rng.choice(("", "", " " + words[k][: rng.randint(1, 3)] if k < len(words) else ""))
            foreign = int(rng.random() < 0.08)
            cs.append([cut, "U", rng.choices((0, 1), (6, 1))[0], foreign, rng.choices(("odd", "open"), (3, 1))[0]])
        elif kind == "opened":  # an item or a quotation that was only opened
            cs.append(["", "U", 0, 0, "open"])
        elif rng.random() < 0.3:
            if rng.random() < 0.5:
                cs.append([rng.choice(fillers), "N", 0, 0, rng.choice(("mark", "fits", "odd"))])
            elif cs[-1][1] in "AF":
                cs[-1] = [cs[-1][0].rstrip("."), *cs[-1][1:4], "fits"]
        out.append([(*c, int(k == len(cs) - 1), int(len(cs) == 1)) for k, c in enumerate(cs)])
    return out
