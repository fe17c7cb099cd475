"""Fixed values, as text in their natural order: word lists, phrases, tables and patterns whose content decides results."""

#: Frequent Urdu words in Arabic letters.
URDU_WORDS = tuple(
    w.strip()
    for w in """
ہے | ہیں | ہو | ہوں | ہوگا | ہوگی | یہ | وہ | کیا | کون | کہاں | کب | کیسے | کیوں | ہم | تم | آپ | مجھے | تجھے | انہوں | کی | کا | کو | کے | سے | میں
| پر | نے | تک | کیلئے | کیساتھ | کیبعد | لئے | ساتھ | بعد | کرنا | کرتا | کرتے | کریں | رہا | رہے | رہی | ہوتا | ہوتی | ہوتے | جاتا | جاتے | آتا |
آتے | دیکھنا | دیکھو | دیکھیں | دیکھا | دیکھتے | سمجھنا | سمجھو | سمجھیں | سمجھا | سمجھتے | سوچنا | سوچو | سوچیں | سوچا | بتانا | بتاؤ | بتائیں |
بتایا | سننا | سنو | سنیں | سنا | سنتے | پڑھنا | پڑھو | پڑھیں | پڑھا | پڑھتے | ملنا | ملا | ملتا | ملے | ملیں | چاہنا | چاہتا | چاہتے | چاہیے | سکتا |
سکتے | سکتی | سکیں | دینا | دیتا | دیتے | دیں | دیا | لینا | لیتا | لیتے | لیا | آنا | آئے | آئیں | آیا | جانا | جائے | جائیں | گیا | گئے | گئی | لوگ
| لوگوں | بہت | ابھی | بھی | نہیں | ہاں | لیکن | مگر | اور | پھر | تو | جب | اگر | والا | والے | والی | اچھا | اچھے | بات | ضرور | شاید | بالکل | کبھی
| ہمیشہ | یعنی | مثلاً | خاص | صرف | سب | کچھ | وجہ | طرف | طریقہ | مطلب | حکم | خیال | نماز | روزہ | زکوٰة | حج | مسجد | مدرسہ | مولانا | صاحب | حضور
| بیان | خطبہ | درس | عالم | مفتی | علماء | فتویٰ | تبلیغ | آج | کل | پہلے | اب | پہلا | دوسرا | تیسرا | چوتھا | ایک | دو | تین | چار | پانچ | هوتا |
هوتي | هونا | كرنا | كرتا | كرتي | بهت | نهيں | كيا | كيوں | ليكن | هاں | بهي | ابهي | پهر | اچها | خواهش | دروازة | روتين | باكستان
""".split("|")
)

#: Phrases that speech recognition makes up in silence, music or noise.
SPURIOUS_PHRASES = tuple(
    w.strip()
    for w in """
اشتركوا في القناة | شكرا للمشاهدة | لا تنسوا الاشتراك | اشترك في القناة | شكراً للمشاهدة | لا تنسى الاشتراك والإعجاب | تابعونا على | اشتراك في القناة
| لا تنسى الاشتراك في القناة | اشترك وفعل زر الجرس | اذا اعجبك الفيديو | لا تنسى الاشتراك | شكرا لكم على المشاهدة | مشاهدة ممتعة | نراكم في الحلقة
القادمة | السلام عليكم ورحمة الله | Thanks for watching | Please subscribe | Don't forget to subscribe | Like and subscribe | Hit the bell icon | See
you in the next video | Thank you for watching | Please like and subscribe | چینل کو سبسکرائب کریں | لائک اور سبسکرائب کریں | ویڈیو کو لائک کریں | ...
| ♪ | ♪♪ | ♪♪♪ | [موسيقى] | [تصفيق] | [音楽] | MBC | Amara.org | www.mooji.org | Sous-titres réalisés par la communauté | ترجمة | Subtítulos
""".split("|")
)

#: Arabic function words.
ARABIC_STOPWORDS = tuple(
    w.strip()
    for w in """
من | في | على | الى | عن | ان | ما | لا | الا | هو | هي | هم | الذي | التي | الذين | كل | بعد | قبل | بين | عند | حتى | ثم | او | لم | لن | قد
""".split("|")
)

#: Formulas that lectures repeat on purpose.
REPEATABLE_FORMULAS = tuple(
    w.strip()
    for w in """
صلى الله عليه وسلم | سبحان الله | الحمد لله | الله اكبر | لا اله الا الله | استغفر الله | رضي الله عنه | رضي الله عنها | رحمه الله | سبحانه وتعالى |
عز وجل | ان شاء الله | ما شاء الله | بسم الله الرحمن الرحيم | جزاك الله خيرا | بارك الله فيك | لا حول ولا قوة الا بالله | حسبنا الله ونعم الوكيل | انا
لله وانا اليه راجعون
""".split("|")
)

#: Words that most narrations share.
GENERIC_NARRATION_WORDS = tuple(
    w.strip()
    for w in """
قال | رسول | الله | صلي | عليه | وسلم | النبي | عن | حدثنا | اخبرنا | سمعت | يقول | رضي | تعالي
""".split("|")
)

#: Formulas (before canonical form) and their labels, in order.
FORMULAS = (
    ("صلى الله عليه وسلم", "Salawat (Durood Ibrahim)"),
    ("رضي الله عنه", "Radhi Allahu anhu"),
    ("رضي الله عنها", "Radhi Allahu anha"),
    ("رضي الله عنهم", "Radhi Allahu anhum"),
    ("رحمه الله", "Rahimahullah"),
    ("رحمها الله", "Rahimahallah"),
    ("جل جلاله", "Jalla Jalaluhu"),
    ("سبحانه وتعالى", "Subhanahu wa Ta'ala"),
    ("عز وجل", "Azza wa Jall"),
    ("تبارك وتعالى", "Tabaraka wa Ta'ala"),
    ("الله اكبر", "Takbir"),
    ("سبحان الله", "Tasbih"),
    ("الحمد لله", "Tahmid"),
    ("لا اله الا الله", "Tahlil"),
    ("استغفر الله", "Istighfar"),
    ("لا حول ولا قوة الا بالله", "Hawqala"),
    ("انا لله وانا اليه راجعون", "Istirja (Inna lillahi)"),
    ("حسبنا الله ونعم الوكيل", "Hasbunallah"),
    ("ما شاء الله", "Masha'Allah"),
    ("ان شاء الله", "Insha'Allah"),
    ("بارك الله فيك", "Barakallahu feek"),
    ("جزاك الله خيرا", "Jazakallahu khairan"),
    ("اللهم صل على محمد", "Salawat (short form)"),
    ("اللهم صل على سيدنا محمد", "Salawat (formal)"),
    ("يا رسول الله", "Ya Rasulallah (address)"),
    ("اللہم صلی اللہ علیہ وسلم", "Salawat (Urdu script)"),
    ("صلی اللہ علیہ وسلم", "Salawat (Urdu script)"),
    ("اللہم صل علیہ وسلم", "Salawat (Urdu script)"),
    ("رضی اللہ عنہ", "Radhi Allahu anhu (Urdu script)"),
    ("رضی اللہ عنها", "Radhi Allahu anha (Urdu script)"),
    ("رضی اللہ عنهم", "Radhi Allahu anhum (Urdu script)"),
    ("بسم اللہ الرحمن الرحیم", "Basmala (Urdu script)"),
    ("الحمدللہ", "Tahmid (merged)"),
    ("سبحان اللہ", "Tasbih (Urdu script)"),
)

#: Corrections in order: what is written, what is meant. Patterns.
EXPANSIONS = (
    (r"\bصلعم\b", "صلى الله عليه وسلم"),
    (r"\bﷺ", "صلى الله عليه وسلم"),
    (r"\bرض\b", "رضي الله عنه"),
    (r"\bرح\b", "رحمه الله"),
    ("انشاءالله", "إن شاء الله"),
    ("انشالله", "إن شاء الله"),
    ("ماشاءالله", "ما شاء الله"),
    ("ماشالله", "ما شاء الله"),
    ("الحمدالله", "الحمد لله"),
    ("الحمدللہ", "الحمد للہ"),
    ("جزاکالله", "جزاک الله"),
    ("جزاكالله", "جزاك الله"),
    ("بسمالله", "بسم الله"),
    ("سبحانالله", "سبحان الله"),
    ("استغفرالله", "استغفر الله"),
    ("لاالہ", "لا الہ"),
    ("لااله", "لا اله"),
    ("انکو", "ان کو"),
    ("اسکو", "اس کو"),
    ("اسکی", "اس کی"),
    ("اسکے", "اس کے"),
    ("اسکا", "اس کا"),
    ("جوکہ", "جو کہ"),
    ("حالانکہ", "حالانکہ"),
)

#: Spelling of terms, in order.
TERMS = (
    ("قران", "قرآن"),
    ("الائمه", "الأئمة"),
    ("الأأمة", "الأئمة"),
    ("مسئله", "مسئلہ"),
    ("مسلہ", "مسئلہ"),
    ("بخارى", "بخاری"),
    ("مسلم شريف", "مسلم شریف"),
    ("ترمذى", "ترمذی"),
    ("نبى", "نبی"),
    ("رسول اللہ", "رسول اللہ"),
)

#: Phrases in Latin letters and their Urdu form, in order.
ROMAN_PHRASES = (
    ("sahih bukhari", "صحیح بخاری"),
    ("sahih muslim", "صحیح مسلم"),
    ("sunan tirmidhi", "سنن ترمذی"),
    ("sunan abu dawud", "سنن ابو داؤد"),
    ("sunan nasai", "سنن نسائی"),
    ("sunan ibn majah", "سنن ابن ماجہ"),
    ("surah fatiha", "سورۃ فاتحہ"),
    ("surah baqarah", "سورۃ بقرہ"),
    ("surah yasin", "سورۃ یٰس"),
    ("surah rahman", "سورۃ رحمٰن"),
    ("surah mulk", "سورۃ ملک"),
    ("surah kahf", "سورۃ کہف"),
    ("ayatul kursi", "آیت الکرسی"),
    ("peace be upon him", "صلی اللہ علیہ وسلم"),
    ("pbuh", "صلی اللہ علیہ وسلم"),
    ("insha allah", "ان شاء اللہ"),
    ("masha allah", "ما شاء اللہ"),
    ("subhan allah", "سبحان اللہ"),
    ("alhamdulillah", "الحمد للہ"),
    ("allahu akbar", "اللہ اکبر"),
    ("assalamu alaikum", "السلام علیکم"),
    ("jazakallah", "جزاک اللہ"),
    ("bismillah", "بسم اللہ"),
    ("imam bukhari", "امام بخاری"),
    ("imam muslim", "امام مسلم"),
    ("imam abu hanifa", "امام ابو حنیفہ"),
    ("ibn taymiyyah", "ابن تیمیہ"),
    ("ibn kathir", "ابن کثیر"),
)

#: Category and pattern of narration markers, in order.
NARRATION_MARKERS = (
    ("prophet_speech", r"قال\s+رسول\s+الله"),
    ("prophet_speech", r"قال\s+النبي"),
    ("prophet_said", r"قال\s+صلى\s+الله\s+عليه\s+وسلم"),
    ("narrator_chain", r"عن\s+أبي\s+هريرة"),
    ("narrator_chain", r"عن\s+ابن\s+عمر"),
    ("narrator_chain", r"عن\s+ابن\s+عباس"),
    ("narrator_chain", r"عن\s+عائشة"),
    ("narrator_chain", r"عن\s+أنس"),
    ("narrator_chain", r"عن\s+جابر"),
    ("narrator_generic", r"عن\s+\S+\s+رضي\s+الله\s+عنه"),
    ("transmission", r"حدثنا\b"),
    ("transmission", r"أخبرنا\b"),
    ("transmission", r"اخبرنا\b"),
    ("transmission", r"سمعت\b"),
    ("salawat", r"صلى\s+الله\s+عليه\s+وسلم"),
    ("urdu_narrator", r"حضرت\s+ابو\s*ہریرہ"),
    ("urdu_narrator", r"حضرت\s+عائشہ"),
    ("urdu_narrator", r"حضرت\s+انس"),
    ("urdu_prophet", r"نبی\s+کریم"),
    ("urdu_prophet", r"رسول\s+اللہ"),
    ("urdu_salawat", r"صلی\s+اللہ\s+علیہ\s+وسلم"),
    ("collection_ref", r"صحیح\s+بخاری"),
    ("collection_ref", r"صحیح\s+مسلم"),
    ("collection_ref", r"سنن\s+ترمذی"),
)

#: Names of collections by how sources write them.
COLLECTIONS = (
    ("sahih bukhari", "bukhari"),
    ("sahih muslim", "muslim"),
    ("jami' al-tirmidhi", "tirmidhi"),
    ("jami al-tirmidhi", "tirmidhi"),
    ("sunan abi da'ud", "abudawud"),
    ("sunan abi dawud", "abudawud"),
    ("sunan an-nasa'i", "nasai"),
    ("sunan an-nasai", "nasai"),
    ("sunan ibn majah", "ibnmajah"),
)
