"""Language posteriors from character n-gram naive Bayes."""

from __future__ import annotations

import re

import numpy as np

#: log2 of the feature table of each language; n-grams of one to three characters are hashed into it.
FEATURE_BITS = 15
_V = 1 << FEATURE_BITS
_SEEN = 0.9
_OTHER = re.compile(r"[\W\d_]+")

#: A little ordinary text of each language, the only training text of those the corpus itself does not hold.
SEEDS = {
    "ar": "في عام كذا انتقل الرجل إلى القرية وعمل مع عدد من أهلها في بناء المدرسة. كان الناس يعرفون أنه من أسرة كبيرة، وقد ساعدهم على تعلم القراءة. ثم عاد بعد ذلك إلى المدينة التي ولد فيها. هذا ما ذكره الكتاب عن حياته وعن أعماله، ولم يبق منها سوى القليل. لأن الطريق كان طويلا فقد أقام هناك حتى الصيف.",
    "en": "In that year the man moved to the village and worked with some of its people on the building of a school. They knew that he came from a large family, and he helped them to learn reading. After that he went back to the town where he was born. This is what the book said about his life and his works, of which only a few remain. Because the road was long he stayed there until the summer.",
    "fr": "Cette année-là, l'homme est parti pour le village et il a travaillé avec des habitants à la construction d'une école. Ils savaient qu'il venait d'une grande famille et il les a aidés à apprendre la lecture. Après cela, il est retourné dans la ville où il était né. C'est ce que le livre a dit de sa vie et de ses œuvres, dont il ne reste que peu. Parce que la route était longue, il y est resté jusqu'à l'été avec sa femme et ses enfants. Grâce à son frère, elle a pu vivre dans cette maison vers la fin du siècle, selon les lettres qui ont été trouvées. Il a été fondé par le père et puis dirigé par son fils pendant plusieurs années. Je ne sais pas qui lui a donné ce nom, mais nous avons besoin de le savoir encore.",
    "fa": "در آن سال مرد به روستا رفت و با چند نفر از مردم برای ساختن مدرسه کار کرد. آنها می‌دانستند که او از خانواده بزرگی است و به آنها کمک کرد که خواندن را یاد بگیرند. پس از آن به شهری که در آن به دنیا آمده بود برگشت. این چیزی است که کتاب درباره زندگی او گفته است و تنها کمی از آن باقی مانده. چون راه دور بود تا تابستان آنجا ماند. زیرا مردم نیاز داشتند و کسی نبود که این کار را انجام بدهد. وی توانست با همکاری برادرش چند سال درس بدهد و خانه‌اش را بسازد. هنوز هم نمی‌دانم چرا این نام را به آن داده‌اند اما باید گفت که خیلی زیبا بود. برای اینکه پدرش آن را ساخت و اداره می‌کرد.",
    "es": "En aquel año el hombre se fue al pueblo y trabajó con algunos de sus habitantes en la construcción de una escuela. Sabían que venía de una familia grande y les ayudó a aprender a leer. Después volvió a la ciudad donde había nacido. Esto es lo que dijo el libro sobre su vida y sus obras, de las que quedan pocas. Como el camino era largo se quedó allí hasta el verano con su mujer y sus hijos. Gracias a su hermano pudo vivir en esa casa, según las cartas que fueron encontradas. Fue fundado por el padre y luego dirigido por el hijo durante muchos años.",
    "de": "In jenem Jahr zog der Mann in das Dorf und arbeitete mit einigen seiner Bewohner am Bau einer Schule. Sie wussten, dass er aus einer großen Familie kam, und er half ihnen, das Lesen zu lernen. Danach ging er in die Stadt zurück, in der er geboren war. Das ist es, was das Buch über sein Leben und seine Werke sagte, von denen nur wenige geblieben sind. Weil der Weg lang war, blieb er dort bis zum Sommer mit seiner Frau und den Kindern. Dank seinem Bruder konnte er in diesem Haus wohnen. Es wurde vom Vater gegründet und dann viele Jahre von seinem Sohn geleitet.",
    "it": "In quell'anno l'uomo andò nel villaggio e lavorò con alcuni dei suoi abitanti alla costruzione di una scuola. Sapevano che veniva da una grande famiglia e li aiutò a imparare a leggere. Dopo di ciò tornò nella città dove era nato. Questo è quello che il libro ha detto della sua vita e delle sue opere, di cui ne restano poche. Poiché la strada era lunga rimase lì fino all'estate con la moglie e i figli. Grazie a suo fratello poté vivere in quella casa, secondo le lettere che sono state trovate.",
    "tr": "O yıl adam köye gitti ve okulun yapımında halktan bazılarıyla birlikte çalıştı. Onun büyük bir aileden geldiğini biliyorlardı ve onlara okumayı öğrenmeleri için yardım etti. Bundan sonra doğduğu şehre geri döndü. Kitabın onun hayatı ve eserleri hakkında söylediği budur, onlardan çok azı kaldı. Yol uzun olduğu için yaza kadar orada kaldı. Kardeşi sayesinde o evde yaşayabildi. Babası tarafından kuruldu ve sonra oğlu tarafından uzun yıllar yönetildi. Çünkü insanların buna ihtiyacı vardı.",
    "ur": "اس سال وہ آدمی گاؤں گیا اور اس نے کچھ لوگوں کے ساتھ مل کر اسکول کی تعمیر میں کام کیا۔ وہ جانتے تھے کہ وہ ایک بڑے خاندان سے ہے اور اس نے پڑھنا سیکھنے میں ان کی مدد کی۔ اس کے بعد وہ اس شہر میں واپس آیا جہاں وہ پیدا ہوا تھا۔ کتاب نے اس کی زندگی اور اس کے کاموں کے بارے میں یہی کہا ہے، جن میں سے بہت کم باقی ہیں۔ چونکہ راستہ لمبا تھا اس لیے وہ گرمیوں تک وہیں رہا۔ کیونکہ لوگوں کو اس کی ضرورت تھی۔",
}


def features(text: str) -> np.ndarray:
    """Hashed n-grams of one to three characters; digits and punctuation count as spaces."""
    clean = f" {_OTHER.sub(' ', text.lower()).strip()} "
    c = np.frombuffer(clean.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, dtype=np.int64)
    two = c[:-1] * np.uint64(1_000_003) + c[1:]
    three = two[:-1] * np.uint64(1_000_003) + c[2:]
    h = np.concatenate((c[1:-1] + np.uint64(7), two * np.uint64(0x9E3779B1), three * np.uint64(0x85EBCA6B)))
    return ((h ^ (h >> np.uint64(17))) & np.uint64(_V - 1)).astype(np.int64)


class Languages:
    """counts: for each language the feature counts of corpus text, added to its seed."""

    def __init__(self, counts: dict[str, np.ndarray] | None = None) -> None:
        self.names = list(SEEDS)
        rows = []
        for name in self.names:
            seed = np.bincount(features(SEEDS[name]), minlength=_V).astype(float)
            p = seed / seed.sum()
            if counts and name in counts and counts[name].sum() > 0:
                p = 0.5 * p + 0.5 * counts[name] / counts[name].sum()
            rows.append(np.log(_SEEN * p + (1 - _SEEN) / _V))
        self.table = np.array(rows)

    def log_posteriors(self, text: str) -> np.ndarray:
        """Log posterior of each language under equal priors; n-grams of a text overlap, so their evidence is tempered."""
        s = self.table[:, features(text)].sum(axis=1) / 3
        s -= s.max()
        return s - np.log(np.exp(s).sum())
