"""Stop words by language code.

Languages whose lists are longer than some 200 words aren't here: ``packs.stop_words`` takes those of Spark's own lists, or
a list given to it.
"""

# Common stop-word lists, in their usual order, one space apart; "_" stands for a space inside an entry.
WORDS = {
    "am": """እኔ አንተ አንቺ እሱ እርሱ እርሷ እሷ እኛ እናንተ እነሱ እነርሱ ይህ ይህች እነዚህ ያ ያች እነዚያ ማን ምን የት መቼ ለምን እንዴት ስንት የትኛው የትኛዋ በ ከ ለ ስለ እንደ ጋር ውስጥ ላይ ውጭ ወደ እስከ እና ወይም ግን ስለዚህ
ስለሆነ ምክንያቱም እንዲሁም ስለዚያ ስለምን ከሆነ ብ ካልሆነ አይ አዎ የለም አይደለም አይደለችም አይደሉም ነው ናት ናቸው ነኝ ነህ ነሽ ነን ነበር አለ አለች አሉ ሁሉ ብቻ እጅግ ደግሞ አሁን ዛሬ ትናንት ነገ ሁልጊዜ አንዳንድ""",
    "ar": """في من إلى على عن مع عند لدى بين حول خلال بعد قبل تحت فوق أمام خلف وراء داخل خارج و أو ثم ف أم بل لكن حتى أن إن أنه أنها إذ إذا لو لأن لكي كي بينما حيث
عندما طالما منذ هذا هذه هذان هاتان هؤلاء ذلك تلك ذاك أولئك هنا هناك هنالك أنا نحن أنت أنتِ أنتما أنتم أنتن هو هي هما هم هن ماذا متى أين كيف كم لماذا
هل أي أية أيها أيتها لا ما لم لن لست ليس ليست ليسا ليسوا كان كانت كانوا كن يكون تكون أكون نكون يكونون كائن له لها لهم لهن لك لكم لي لنا عنده عندها
عندهم لديه لديها لديهم كل بعض غير سوى أيضا كذلك أيضًا جدا جداً فقط قد لقد سوف س قط أبدا الآن اليوم أمس غدا دائما أحيانا ربما لعل كأن الذي التي الذين
اللاتي اللواتي اللذان اللتان نعم بلى كلا إذن إذًا طبعا""",
    "be": """я ты ён яна яно мы вы яны мяне цябе яго яе нас вас іх мне табе яму ёй ім мой мая маё мае твой твая наш наша ваш ваша свой гэта гэты гэтая гэтае той
тая тое тыя хто што які якая якое якія як дзе куды калі чаму і а але або ці ды ж у ў на за пад над перад па да з ад для без аб пры праз не ні бы б ужо
яшчэ толькі таксама быць ёсць быў была было былі будзе будуць тут там вось вельмі""",
    "bn": """আমি আমাকে আমার আমরা আমাদের তুমি তোমাকে তোমার তোমরা তোমাদের আপনি আপনার তুই সে তিনি তার তাকে তাহার তারা তাদের এই এটা এটি ওই ওটা সেই সেটা কি কী কে কেন
কীভাবে কোথায় কখন কোন এর তে থেকে দিয়ে জন্য উপর নিচে সাথে মধ্যে কাছে পরে আগে এবং ও বা কিন্তু তবে যদি তাহলে কারণ যে যা যখন তখন না নয় নেই আছে আছেন ছিল
ছিলেন হয় হবে হয়েছে হচ্ছে করে করেন করছে করবে করেছে সব কিছু অনেক খুব শুধু শুধুমাত্র আবার এখন তারপর এক দুই তিন""",
    "da": """og i jeg det at en et den til er som på de med han af for ikke der var mig sig men har om vi min havde ham hun nu over da fra du ud sin dem os op man
hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo deres efter ned skulle denne end dette mit også under have dig
anden hende mine alt meget sit sine vor mod disse hvis din nogle hos blive mange ad bliver hendes været thi jer sådan vær haft kan kunnet villet
skullet må måtte måttet bør burde aldrig altid bare hvorfor hvornår således derfor endnu kun kanske""",
    "el": """εγω εσυ αυτοσ αυτη αυτο εμεισ εσεισ αυτοι αυτεσ αυτα με σε τον την μασ σασ τουσ τισ τα μου σου του τησ μασ σασ τουσ εμενα εσενα εμασ εσασ δικοσ δικη
δικο δικοι δικεσ δικα τετοιοσ τετοια τετοιο τοσοσ τοση τοσο εκεινοσ εκεινη εκεινο εκεινοι εκεινεσ εκεινα ιδιοσ ιδια ιδιο ο η το οι οι τα ενασ μια μιασ
ενοσ ενα τησ του των ποιοσ ποια ποιο ποιοι ποιεσ ποια τι που πωσ ποτε γιατι ποσο ποσοι ποσα ποσεσ και κι η ειτε αλλα ομωσ μα παρα ουτε μηδε ωστε αν
εαν οτι πωσ διοτι επειδη αφου μολισ οταν εφοσον ενω μηπωσ μηπωσ ωσπου εωσ σε στον στην στο στουσ στισ στα απο με για χωρισ μεταξυ μεσα μεσω προσ κατα
παρα υπο υπερ εξω πριν μετα εναντια εναντιον να θα δεν μην μη ναι οχι ασ μονο πια ακομα ακομη ηδη τωρα εδω εκει τοτε παντα ποτε καποτε ξανα παλι
παντωσ λοιπον επισησ ισωσ μαλλον σχεδον πολυ λιγο μαζι χθεσ σημερα αυριο ειμαι εισαι ειναι ειμαστε εισαστε ειστε ημουν ησουν ηταν ημασταν ησασταν
ητανε εχω εχεισ εχει εχουμε εχετε εχουν ειχα ειχεσ ειχε ειχαμε ειχατε ειχαν ολοσ ολη ολο ολοι ολεσ ολα καθε καποιοσ καποια καποιο καποιοι καποιεσ
καποια τιποτα κανεισ κανενασ καμια κανενα λιγοσ λιγη λιγοι λιγεσ λιγα πολλοσ πολλη πολλοι πολλεσ πολλα αλλοσ αλλη αλλο αλλοι αλλεσ αλλα""",
    "en": """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down
during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my
myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them
themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your
yours yourself yourselves also another back come could even get give go like make many must never new one say see since still take well would""",
    "et": """ma mina sa sina ta tema me meie te teie nad nemad mu minu su sinu ise see need too nood selle seda siin seal sinna siia sealt siit mis kes kelle keda
mida millal kus kuhu kust miks kuidas kui kumb ja ning või kas et aga kuid vaid sest kuna kuigi ehk nagu ei ära ärge mitte olema olen oled on oleme
olete olin olid oli olime olite olnud olev oleks juures peal all ees taga kõrval vahel sees väljas üle läbi vastu ilma koos pärast enne nüüd siis kohe
juba veel alati kunagi eile täna homme kõik iga mõni palju vähe üks kaks kolm neli viis väga üsna päris ainult ka samuti nii niimoodi jah küll ju""",
    "fa": """در از به با بر برای بی تا جز سوی پس پیش نزد روی زیر بالای پایین کنار میان بین درباره توسط مانند مثل غیر بدون و یا اما ولی لکن ولیکن اگر چون زیرا چراکه
هرچند اگرچه بنابراین لذا چه همچنین همچنان همان‌طور همانطور که وقتی هنگامی زمانی من تو او وی ما شما ایشان آنها آن‌ها اینها این‌ها خود خودم خودت خودش
خودمان خودتان خودشان این آن همین همان چنین چنان اینجا آنجا اینک اکنون چرا چگونه چطور کجا کی کی‌ست چند چقدر کدام کیست آیا نه نی هرگز هیچ است هست نیست
هستم هستی هستیم هستید هستند بود بودم بودی بودیم بودید بودند باشد باشم باشی باشیم باشید باشند بوده شد شده شدن می‌شود می‌شد دارد دارم داری داریم دارید
دارند داشت داشتم داشتی داشتیم داشتید داشتند داشته همه هر دیگر دیگری بعد قبل حالا الان امروز دیروز فردا همیشه هنوز خیلی بسیار کاملا کاملاً تقریبا
تقریباً شاید حتی فقط تنها نیز هم بلکه یعنی مثلا مثلاً البته را ای یک دو سه چهار پنج شش هفت هشت ده بله آری خیر طبعا طبعاً""",
    "he": """של על אל את עם בין אצל לפני אחרי תחת מעל ליד מול בלי עד מן בתוך מתוך ו או אבל אך אלא וגם אם כי כאשר כש לפי כמו כדי בגלל למרות אף אפילו זה זאת זו אלה
אלו הזה הזאת ההוא ההיא ההם ההן אני אתה הוא היא אנחנו אנו אתם אתן הם הן אותו אותה אותם אותן אותי אותך אותנו אתכם שלי שלך שלו שלה שלנו שלכם שלכן שלהם
שלהן מה מי איפה היכן מתי איך כמה למה מדוע האם איזה איזו לא אין אינו אינה אינם אינן אסור היה היתה היינו הייתם היו יהיה תהיה יהיו יש להיות כל רק מאוד גם
עוד כבר אולי בטח בוודאי פה שם כאן עכשיו היום אתמול מחר תמיד לפעמים לעולם יותר פחות הכי כך לכן אז כן טוב בסדר""",
    "hi": """मैं मुझे मेरा मेरी मेरे हम हमें हमारा हमारी हमारे तू तुझे तेरा तेरी तेरे तुम तुम्हें तुम्हारा तुम्हारी तुम्हारे आप आपको आपका आपकी आपके वह वे यह ये उसे
उन्हें इसे इन्हें उसका उसकी उसके उनका उनकी उनके इसका इसकी इसके इनका इनकी इनके यहाँ वहाँ यहां वहां कहाँ कहां जहाँ जहां ऐसा ऐसी ऐसे वैसा वैसी वैसे क्या
कौन क्यों कैसे कैसा कैसी कब कितना कितनी कितने का की के को ने से में पर तक साथ लिए बिना पास बीच ऊपर नीचे आगे पीछे अंदर बाहर और या लेकिन किंतु परन्तु
अगर यदि तो क्योंकि कि जब तब जो जिसे नहीं मत न है हैं था थी थे थीं हूँ हूं हो होगा होगी होंगे होना होने हुआ हुई हुए करना करता करती करते किया किए किये
अब फिर बहुत थोड़ा थोड़ी सब कुछ कोई हर यही वही सिर्फ केवल भी ही जी एक दो तीन""",
    "hu": """én te ő mi ti ők maga maguk önök ön ez ezek azok ilyen olyan ilyenek olyanok ezt azt ki mit kit mely melyik milyen hogyan hogy miért mikor hol hova
honnan hány mennyi és vagy de mert hanem hisz hiszen azaz avagy illetve valamint ám azonban viszont mégis tehát sőt ugyanis csakhogy amikor ahogy
ahogyan ahol amiért amint aki amely ami alatt alá alól előtt elé elől mögött mögé mögül között közé közül mellett mellé mellől után felé felől körül
által ellen helyett iránt miatt nélkül óta szerint végett át nem sem igen talán csak még már most ma tegnap holnap itt ott amott mindig sohasem soha
néha gyakran olykor hirtelen egyszer kétszer többször sokszor mindenki senki valaki bárki akárki minden semmi valami bármi akármi mindegyik mindkettő
sok kevés több kevesebb legtöbb néhány egyik másik többi többek elég nagyon eléggé igazán körülbelül valóban tényleg esetleg vagyis ismét újra megint
előbb később van vannak volt voltak lesz lesznek legyen lenne lennének lett lettek nincs nincsen nincsenek sincs sincsenek a az egy is se pedig hát
bizony vele velem veled velünk veletek velük róla róluk hozzá hozzám hozzád hozzánk hozzátok hozzájuk neki nekem neked nekünk nektek nekik""",
    "hy": """ես դու նա մենք դուք նրանք այս այդ այն սա դա նա ով ինչ որ որտեղ երբ ինչու ինչպես որքան և եւ կամ բայց որովհետև եթե որպեսզի թե թեև երբ մեջ վրա տակ մոտ
հետ առանց համար մասին եմ ես է ենք եք են չէ չեմ չես չենք չեք չեն ոչ այո իսկ շատ քիչ այսօր երեկ վաղը արդեն նաև միայն դեռ նույնիսկ""",
    "id": """dan atau tetapi tapi namun melainkan sedangkan serta karena sebab jika kalau bila apabila supaya agar walaupun meskipun sehingga maka yang di ke dari
pada kepada dalam untuk dengan tanpa oleh atas bawah antara tentang hingga sampai saya aku kamu engkau anda dia beliau ia kami kita kalian mereka ini
itu sini situ sana begini begitu apa siapa mana kapan bagaimana mengapa kenapa berapa adalah ialah ada tidak tak bukan belum sudah telah akan sedang
masih pernah boleh harus wajib mesti bisa dapat sangat amat sekali cukup hampir lebih kurang sekitar sekarang kemarin besok lalu juga pula hanya saja
cuma pun satu dua tiga empat lima enam tujuh delapan sembilan sepuluh""",
    "is": """og en eða að sem því þó svo nú þá í á af til frá með um yfir undir við eftir fyrir hjá milli gegn án það þessi þetta þessa sá sú þau þeir þær þess ég
mig mér mín þú þig þér þín hann hana honum hans hún henni hennar okkur okkar þið ykkur ykkar þeim þeirra hver hvað hvor hvenær hvar hvernig hvers ekki
aldrei alltaf kannski líka bara aðeins mjög er ert erum eruð eru var varst vorum voruð voru sé vera verið hef hefur höfum hafið hafa hafði hafðir
höfðum höfðuð höfðu haft skal skalt skulum skuluð skulu skyldi vil vilt viljum viljið vilja vildi get getur getum getið geta gat má mátt megum megið
mega mátti""",
    "it": """il la lo i gli le un uno una di a da in con su per tra fra e o ma che io tu noi voi mi si non come essere avere fare dire andare potere dovere volere
sapere""",
    "ja": """は が を に へ で と から まで より の も や など だけ ばかり しか こそ さえ でも ほど くらい ぐらい まま ずつ て ながら つつ ので のに けど けれど けれども し たり だり か ね よ わ な ぞ さ かな かしら だ です である でした でしょう だった だろう
ます ました ません ましょう ない なかった ん ぬ た つ たい たかった らしい そうだ ようだ みたい べき べきだ する した して される させる できる ある あった いる いた なる なった いう 言う これ それ あれ どれ この その あの どの ここ そこ あそこ どこ こう
そう ああ どう こちら そちら あちら どちら こんな そんな あんな どんな 私 わたし 僕 ぼく 俺 おれ あなた あんた 君 きみ 彼 彼女 我々 彼ら 彼女ら そして しかし また ただ つまり なお やはり もっと よく とても ずっと まだ もう すぐ ほとんど たぶん きっと
ちょっと""",
    "ka": """მე შენ ის ჩვენ თქვენ ისინი მას იმას ამას მან ჩემი შენი მისი ჩვენი თქვენი მათი ეს იმ ამ ვარ ხარ არის ვართ ხართ არიან იყო იყვნენ იქნება არ არა ვერ ნუ
დიახ კი ხო და ან მაგრამ ხოლო თუ რომ როცა სანამ თუმცა რადგან რა ვინ ვინც სად როგორ რატომ როდის ერთი ორი სამი ბევრი ცოტა ყველა ყოველი აქ იქ ახლა მერე
უკვე ჯერ ისე ასე როგორც ვიდრე""",
    "ko": """이 그 저 이것 그것 저것 여기 거기 저기 누구 무엇 뭐 어디 언제 어떻게 왜 어느 얼마 것 수 등 때 곳 말 일 그리고 하지만 그러나 그런데 그래서 따라서 또는 혹은 및 즉 만약 매우 아주 너무 정말 진짜 잘 다시 또 이미 아직 곧 먼저 함께 다 모든 많은 적은 조금
약간 거의 가장 더 있다 없다 되다 하다 이다 아니다""",
    "mk": """јас ти тој таа тоа ние вие тие мене тебе него неа нив ме те го ја ги му ѝ им си се нѐ ве мој моја мое мои твој твоја твое твои негов нејзин наш наша
наше наши ваш нивен свој овој оваа ова овие оној онаа она оние кој која кое кои каков каква какво какви каде кога како зошто колку што и а но или ако
оти дека додека туку ниту не да па во на за со од до по при под над пред зад меѓу околу без кон низ врз спрема според би ќе ли нели ете еве уште само
исто сум е сме сте бев беше бе бевме бевте беа бил била било биле сега тогаш потоа денес вчера утре често секогаш никогаш многу малку речиси веќе еден
една едно едни два две три секој секоја секое сите некој некоја некое некои друг друга друго други сѐ ништо никој""",
    "ml": """ഞാൻ എന്റെ എനിക്ക് എന്നെ നീ നിന്റെ നിങ്ങൾ അവൻ അവൾ അവർ അത് ഇത് നമ്മൾ ഞങ്ങൾ അവരുടെ ഈ ആ എന്ത് എന്ത എങ്ങനെ എന്തുകൊണ്ട് എപ്പോൾ എവിടെ ആര് ഏത് ഒപ്പം
അല്ലെങ്കിൽ പക്ഷേ എന്നാൽ അതിനാൽ കാരണം എന്ന് കൂടാതെ ഇല്ല അല്ല ഉവ്വ് വേണ്ട ആണ് ആയിരുന്നു ഉണ്ട് ആകുന്നു ആയി നിന്ന് വരെ മുകളിൽ താഴെ ഉള്ളിൽ പുറത്ത് ഇവിടെ
അവിടെ ഇപ്പോൾ അപ്പോൾ ഒരു പല എല്ലാം ചില വളരെ മാത്രം കൂടി""",
    "mr": """मी मला माझा माझी माझे आम्ही आपण आमचा आमची आमचे तू तुला तुझा तुझी तुझे तुम्ही तुमचा तुमची तुमचे तो ती ते त्याला तिला त्यांना त्याचा त्याची त्याचे हा ही
हे इथे तिथे काय कोण का कसे केव्हा कुठे कोणता कोणती साठी बद्दल बरोबर पासून पर्यंत शिवाय आणि किंवा पण परंतु जर तर कारण म्हणून की जेव्हा तेव्हा जसे तसे
नाही नको होय हो आहे आहेत होता होती होते करतो करते करतात केला केली केले आता मग खूप थोडे सर्व काही एक दोन तीन""",
    "nl": """de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij
ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets worden toch al waren veel meer doen toen
moet ben zonder kan hun dus alles onder ja eens hier wie werd altijd doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest
andere we jij jullie hen hunne onze onzen onzer onzes zulke zulks zulk dezelfde hetzelfde diezelfde datzelfde welke welk welken zijnde ware hebt
hadden gehad hebbende zult zullen zouden zoudt werden geworden wordende kunt konden gekund moeten moest moesten gemoeten mag mogen mocht mochten
gemogen wilt willen wilde wilden wou wouden gewild doe doet deed deden gedaan doende echter steeds dikwijls vaak misschien wel eigenlijk vooral ergens
nergens overal waarom wanneer waarheen waar één""",
    "nn": """og eller men at som fordi difor då medan når enn både anten eg meg du deg han honom ho henne hennar det me vi oss de dykk dykkar dei deim deira seg
min mi mitt mine din di ditt dine hans sin si sitt sine vår vårt våre ein ei eit den denne dette desse same slik slike kvar kvart alle all alt nokon
noka nokor noko nokre ingen ingi inkje mange mykje lite fleire kva kven kvifor korleis ikkje ja nei i på til med av for frå om ved mot etter før over
under mellom gjennom utan hjå her der no sidan sia so også òg opp ned ut inn inni attende sjølv berre elles å vera er var vore ha har hadde hatt kan
kunne skal skulle vil ville må måtte bør burde verta vert vart vorte blir bli blei blitt""",
    "no": """og i jeg det at en et den til er som på de med han av ikke der så var meg seg men ett har om vi min mitt ha hadde hun nå over da ved fra du ut sin dem
oss opp man kan hans hvor eller hva skal selv sjøl her alle vil bli ble blitt kunne inn når være kom noen noe ville dere deres kun ja etter ned skulle
denne for deg si sine sitt mot å meget hvorfor dette disse uten hvordan ingen din ditt blir samme hvilken hvilke sånn inni mellom vår hver hvem vors
hvis både bare enn fordi før mange også slik vært båe begge siden dykk dykkar dei deira deires deim di då eg ein eit eitt elles honom hjå ho hoe henne
hennar hennes hoss hossen ikkje ingi inkje korleis korso kva kvar kvarhelst kven kvi kvifor me medan mi mine mykje no nokon noka nokor noko nokre sia
sidan so somt somme um upp vore verte vort varte vart""",
    "pa": """ਮੈਂ ਮੈਨੂੰ ਮੇਰਾ ਮੇਰੀ ਅਸੀਂ ਸਾਡਾ ਸਾਡੀ ਤੂੰ ਤੁਸੀਂ ਤੁਹਾਨੂੰ ਤੇਰਾ ਤੇਰੀ ਤੁਹਾਡਾ ਓਹ ਉਹ ਉਸ ਉਹਨਾਂ ਇਹ ਇਸ ਇਹਨਾਂ ਕੀ ਕੌਣ ਕਿਉਂ ਕਿਵੇਂ ਕਿੱਥੇ ਕਦੋਂ ਕਿਹੜਾ ਦਾ ਦੇ ਦੀ ਦੀਆਂ ਨੂੰ
ਵਿੱਚ ਤੋਂ ਨਾਲ ਲਈ ਉੱਤੇ ਹੇਠਾਂ ਅਤੇ ਜਾਂ ਪਰ ਜੇ ਜੇਕਰ ਤਾਂ ਕਿਉਂਕਿ ਜੋ ਨਹੀਂ ਨਾ ਹੈ ਹਾਂ ਹੈਂ ਹੋ ਹਨ ਸੀ ਸਨ ਸਭ ਸਾਰੇ ਕੁਝ ਬਹੁਤ ਹੁਣ ਫਿਰ ਇੱਥੇ ਉੱਥੇ ਇੱਕ ਦੋ""",
    "pt": """de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até
isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses
pelas este dele tu te vocês vos lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas
isto aquilo estou está estamos estão estive esteve estivemos estiveram estava estávamos estavam estivera estivéramos esteja estejamos estejam
estivesse estivéssemos estivessem estiver estivermos estiverem hei há havemos hão houve houvemos houveram houvera houvéramos haja hajamos hajam
houvesse houvéssemos houvessem houver houvermos houverem houverei houverá houveremos houverão houveria houveríamos houveriam sou somos são era éramos
eram fui foi fomos foram fora fôramos seja sejamos sejam fosse fôssemos fossem for formos forem serei será seremos serão seria seríamos seriam tenho
tem temos tém tinha tínhamos tinham tive teve tivemos tiveram tivera tivéramos tenha tenhamos tenham tivesse tivéssemos tivessem tiver tivermos
tiverem terei terá teremos terão teria teríamos teriam""",
    "ro": """un o unei unui unor niște eu tu el ea noi voi ei ele mine tine sine mă te se ne vă îl îi le mi ți ni vi li îmi îți își meu mea mei mele tău ta tăi
tale său sa săi sale nostru noastră noștri noastre vostru voastră voștri voastre lor acest această acești aceste acesta aceasta aceștia acestea acel
acea acei acele acela aceea aceia acelea care cine ce cui cât câtă câți câte unde cum când de_ce și sau ori dar iar însă ci că dacă deși fiindcă
pentru_că ca să nici a la în pe cu de din pentru prin sub spre peste către fără până după între lângă nu da mai foarte cam chiar doar numai prea puțin
mult multă mulți multe așa aici acolo acum atunci apoi mereu niciodată totdeauna azi ieri mâine deja încă fi fie fiu fii fim fiți sunt ești este e
suntem sunteți eram erai era erați erau fost fiind avea am ai are avem aveți au aveam aveai aveau avut având face fac faci facem faceți putea poate
pot poți putem puteți vrea vreau vrei vrem vreți vor tot toată toți toate alt altă alți altele altul alta fel orice oricine nimic nimeni cineva ceva
câțiva câteva""",
    "sr": """ја ти он она оно ми ви они оне мене тебе њега ње њој њему њим њом њих њима нас вас нам вам нама вама мном тобом себе себи собом мој моја моје моји
твој твоја твоје твоји наш наша наше наши ваш ваша ваше ваши његов њен њихов свој своја своје овај ова ово ови ове тај та то те онај у на за са с о од
до из под над пред кроз ка по без око међу и а али или но па јер ако иако док када кад да не ли се већ само још тек чак бити сам си је смо сте су био
била било били биле имам имаш има имамо имате имају где гдје како зашто ту тамо сада тада увек увијек""",
    "sv": """och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har inte hans honom skulle hennes
där min man ej vid kunde något från ut när efter upp vi dem vara vad över än dig kan sina här ha mot alla under någon eller allt mycket sedan ju denna
själv detta åt utan varit hur ingen mitt ni bli blev oss din dessa några deras blir mina samma vilken er sådan vår blivit dess inom mellan sådant
varför varje vilka ditt vem vilket sitta sådana vart dina vars vårt våra ert era vilkas haft hava vore varande bliva kunna kunnat skola skall ska
vilja vill ville velat måste göra gör gjorde gjort ännu aldrig alltid också bara kanske redan således därför helt endast hela""",
    "ta": """நான் என் எனக்கு என்னை நீ உன் நீங்கள் உங்கள் அவன் அவள் அவர் அது இது நாம் நாங்கள் அவர்கள் அவை இந்த அந்த எது என்ன எப்படி ஏன் எப்போது எங்கே யார் எவ்வளவு
மற்றும் அல்லது ஆனால் எனவே ஏனெனில் என்று இல்லை ஆம் அல்ல உள்ளது இருக்கிறது இருந்தது ஆகிறது ஆயிற்று இருந்து வரை மேல் கீழ் உள்ளே வெளியே இங்கே அங்கே
இப்போது அப்போது போது ஒரு பல எல்லாம் சில மிக தான் கூட மட்டும்""",
    "th": """ฉัน ผม เรา คุณ เขา มัน ท่าน นี้ นั้น นี่ โน้น อะไร ทำไม ใคร เมื่อไร ที่ไหน อย่างไร และ แต่ หรือ ถ้า เพราะ แล้ว ใน บน ที่ ของ จาก ถึง กับ โดย เพื่อ ตาม
เป็น ไม่ ไม่ใช่ ให้ ได้ จะ กำลัง อยู่ ไป มา นะ ครับ ค่ะ คะ จ้ะ จ๊ะ มาก น้อย บาง ทุก หลาย ก็""",
    "tr": """ben sen o biz siz onlar beni seni onu bizi sizi onları bana sana ona bize size onlara bende sende onda bizde sizde onlarda benden senden ondan bizden
sizden onlardan benim senin onun bizim sizin onların kendi kendisi kendileri bu şu bunlar şunlar bunu şunu bunun şunun bunda şunda bundan şundan böyle
şöyle öyle ne kim hangi nasıl niye neden niçin nerede nereye nereden kaç kime kimi kimin ve veya ya yada ile ama fakat lakin ancak yalnız ki de da ise
eğer çünkü zira hem gerek ister için gibi kadar göre üzere karşı beri diye dolayı ötürü rağmen önce sonra değil yok hayır evet belki acaba artık hâlâ
hala şimdi bugün yarın dün hemen birden ansızın sık sıkça bazen bazı hep hepsi her herkes hiç hiçbir hiçbiri kimse biraz birçok birkaç birçoğu az çok
daha en pek gayet oldukça yine yeniden tekrar ayrıca üstelik ilk önceki sonraki aynı başka diğer öteki beriki böylece böylelikle böylesine ayrı bile
dahi olan olarak olmak oldu oluyor olacak olur olmuş olabilir olsa etmek etti eder ediyor edecek etmiş şey bir iki üç tüm tümü bütün bazıları orada
burada şurada oraya buraya şuraya oradan buradan şuradan""",
    "uk": """я ти він вона воно ми ви вони мене тебе його її нас вас їх мені тобі йому їй нам вам їм мною тобою ним нею нами вами ними себе собі собою мій моя моє
мої твій твоя твоє твої наш наша наше наші ваш ваша ваше ваші свій своя своє свої цей ця це ці той та те ті такий така таке такі тут там туди сюди
звідти звідси хто що який яка яке які чий чия чиї де куди звідки коли як чому навіщо скільки і й а але або чи ж ні не хоча поки якщо щоб щоби бо тому
адже в у на за під над перед по до з зі із від для без про при через між коло серед біля після крім б би ось от вже ще лише тільки також теж нехай хай
можна треба потрібно повинен повинна повинно повинні може можуть хочу хоче хочемо хочуть бути був була було були є буде будуть буду будеш будемо
будете тепер зараз тоді потім спочатку сьогодні вчора завтра іноді часто рідко завжди ніколи дуже майже зовсім просто звичайно хіба невже один одна
одно одні два дві три багато мало більше менше самий сама саме самі кожен кожна кожне кожні інший інша інше інші весь вся все всіх всякий ніхто ніщо
нічого нікого нікому""",
    "vi": """tôi tao tớ mình ta chúng bạn cậu mày các nó họ hắn y ông bà anh chị em cô chú bác của này nay đây đó kia nọ ấy vậy thế như là có được phải cần nên
muốn định làm cho bị chịu đã đang sẽ vừa mới sắp từng chưa còn hết xong rồi không chẳng chả đừng chớ gì ai nào sao đâu bao nhiêu khi tại trong ngoài
trên dưới trước sau giữa bên cạnh gần xa từ đến tới về qua theo với bằng ở vào ra lên xuống và hoặc hay nhưng mà nếu lúc vì bởi do để tuy dù dẫu mặc
song thì rằng cái con chiếc quyển cuốn tờ bức cây quả trái hạt củ người vị ngôi tòa một hai ba nhiều ít vài mỗi cả toàn tất mọi những số bộ thể rất
quá khá hơi cực hơn kém nhất cũng đều chỉ thôi vẫn luôn thường đôi ngay liền lại nữa thêm hầu à ạ nhé nha nhỉ đấy chứ cơ vâng dạ ừ nói bảo biết nghĩ
tưởng thấy gọi""",
    "zh": """的 地 得 了 着 过 们 我 你 他 她 它 我们 你们 他们 她们 它们 咱们 自己 这 那 这个 那个 这些 那些 是 有 没 没有 不是 就是 不 也 都 很 再 就 还 又 只 只是 和 与 或 或者 但 但是 而 而且 虽然 因为 所以 如果 因此 不过 然后 在 从 到 向 对 把 被
跟 给 为 为了 按 按照 根据 关于 除了 由 什么 哪 哪里 谁 怎么 多少 为什么 太 更 最 已经 现在 吗 呢 吧 啊 呀 哦 啦 嘛""",
}
