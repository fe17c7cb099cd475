"""The prompts that hold a recogniser to a mode or a language."""

MODES = {
    "quran": """یہ قرآن مجید کی تلاوت ہے۔ ہر زبان کو اسی زبان میں لکھیں، ترجمہ نہ کریں۔ بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ۔ الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ۔ الرَّحْمَنِ الرَّحِيمِ۔ مَالِكِ يَوْمِ الدِّينِ۔ إِيَّاكَ نَعْبُدُ وَإِيَّاكَ نَسْتَعِينُ۔ سورة البقرة، سورة آل عمران، سورة النساء، يس، الرحمن، الملك۔ """,
    "hadith": """یہ حدیث نبوی کا بیان ہے۔ ہر زبان کو اسی زبان میں لکھیں، ترجمہ نہ کریں۔ صَلَّى اللَّهُ عَلَيْهِ وَسَلَّمَ۔ ابو ہریرہ، عبداللہ بن عمر، حضرت عائشہ، حضرت انس بن مالک، ابن عباس۔ صحیح بخاری، صحیح مسلم، سنن ترمذی، سنن ابو داؤد، سنن نسائی، سنن ابن ماجہ۔ قال رسول الله، عن أبي هريرة، حدثنا، أخبرنا۔ """,
    "bayan": """یہ ایک اسلامی بیان ہے جس میں اردو، عربی اور انگریزی تینوں زبانیں بولی جاتی ہیں۔ ہر زبان کو اسی زبان میں لکھیں، ترجمہ نہ کریں۔ بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ۔ صَلَّى اللَّهُ عَلَيْهِ وَسَلَّمَ۔ سُبْحَانَ اللَّهِ۔ لَا إِلَهَ إِلَّا اللَّهُ۔ ابو ہریرہ، عبداللہ بن عمر، حضرت عائشہ۔ صحیح بخاری، صحیح مسلم، سنن ترمذی۔ قرآن، حدیث، سنت، صحابہ، تابعین، تفسیر، فقہ، شریعت، عقیدہ۔ سورة البقرة، سورة آل عمران، يس، الرحمن، الملك۔ Islamic, Quran, Hadith, Sunnah, Prophet Muhammad, peace be upon him. Sahih Bukhari, Sahih Muslim, Surah, Ayah, Tafsir.""",
    "naat": """یہ نعتیہ کلام ہے۔ ہر زبان کو اسی زبان میں لکھیں، ترجمہ نہ کریں۔ صَلَّى اللَّهُ عَلَيْهِ وَسَلَّمَ۔ مصطفٰی، حبیب، رسول اکرم، نبی کریم، محمد۔ مدینہ، مکہ، روضہ، حرم۔ """,
}

LANGUAGES = {
    "ar": """بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ۔ الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ۔ الرَّحْمَنِ الرَّحِيمِ۔ مَالِكِ يَوْمِ الدِّينِ۔ إِيَّاكَ نَعْبُدُ وَإِيَّاكَ نَسْتَعِينُ۔ صَدَقَ اللَّهُ الْعَظِيمُ۔ أَعُوذُ بِاللَّهِ مِنَ الشَّيْطَانِ الرَّجِيمِ۔ سُبْحَانَ اللَّهِ وَبِحَمْدِهِ سُبْحَانَ اللَّهِ الْعَظِيمِ۔ قَالَ رَسُولُ اللَّهِ صَلَّى اللَّهُ عَلَيْهِ وَسَلَّمَ۔ """,
    "ur": """یہ اردو میں بیان ہے۔ ہر بات اردو میں لکھیں۔ اللہ تعالیٰ نے فرمایا۔ نبی کریم صلی اللہ علیہ وسلم نے فرمایا۔ حضرات! آج ہم بات کریں گے۔ قرآن مجید، حدیث شریف، صحابہ کرام، تابعین۔ """,
    "en": """This is an Islamic lecture in English. Prophet Muhammad, peace be upon him. Quran, Hadith, Sunnah, Shariah, Tafsir, Fiqh. Sahih Bukhari, Sahih Muslim, Sunan Tirmidhi. """,
}
